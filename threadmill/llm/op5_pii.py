"""Personal data: format-preserving pseudonyms by a keyed Feistel network, in built-in expressions only.

Found and replaced, each within its own format, so that equal values get equal pseudonyms in all documents and different
values different ones:

* card numbers: 13 to 19 digits, bare or in groups (4-4-4-..., 4-6-5), of a card issuer's range and with a valid Luhn digit.
  All but the last digit are permuted among those of issuers' ranges; the check digit is made anew. Other long numbers,
  counters and times among them, stay;
* IBANs with valid check digits: the account's digits are permuted (letters stay), the check digits made anew;
* telephone numbers with a country code (7 to 15 digits), and ten-digit American ones without: the digits after the code
  are permuted, whatever stands between them, so that one number in any layout keeps one pseudonym. A number that is
  valid in the American plan stays so, others stay out of it;
* IPv4 addresses with octets up to 255 and IPv6 addresses: each half of the bits is permuted (an IPv6 one as network and
  interface); every spelling of an IPv6 address gives the same one, written in full;
* social security numbers (3-2-4 digits, no group of zeros, not 666 or 9xx): permuted among such numbers;
* dates of 1900 to 2099 that exist, as yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy: the day's number is permuted;
* what numbers can't name: an e-mail's local part becomes a keyed digest, and so does a secret after token, key, secret
  or password, in its length, whatever that is (quoted, or unquoted with a digit), and the 16 characters of an access key.

The Feistel network alternates between two halves of the digits (or bits, or a date's number): ROUNDS rounds each add a
SHA-256 of key, kind, length, round and the other half, modulo the half's size. Each round is invertible, so the whole
is a permutation of the format; where a value has to stay in a set that isn't a product of two halves, the permutation is
walked on until it is back in it, which is a permutation of that set. A walk is given up after WALK steps (a chance below
1e-17), and the value then stays. All kinds are found by one pattern in one pass; a text is split at the matches and put together again.

Edge cases: a null text stays null, texts without a match stay as they are, matches may be next to each other, at the
ends, or as many as a long text has; a group of digits behind a card number or IBAN is no part of it; equal rows give
equal rows; an empty table gives no rows; other columns pass through whatever their names, and n_replaced, which counts
the values that changed, replaces a column of its name.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.llm.common import free_name, let, table

NAME = "op5_pii"
KEY = "threadmill demonstration key"
ROUNDS = 8
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}"
SECRET = r"""(?i:token|secret|password|passwd|api[_-]?key|key)\s{0,3}[=:]\s{0,3}["'][A-Za-z0-9_\-+/=.]{8,}+["']"""
PHONE = r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z./\-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9A-Za-z]|[./\-][0-9])"
SSN = r"(?<![0-9A-Za-z.\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
# Ranges of card issuers' first four digits.
ISSUER = "(?:222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720|[3-6][0-9]{3})"
CARD = (rf"(?<![0-9A-Za-z]){ISSUER}(?:[0-9]{{9,15}}|(?: [0-9]{{4}}){{2}} [0-9]{{1,4}}(?: [0-9]{{1,3}})?|(?:-[0-9]{{4}}){{2}}-[0-9]{{1,4}}(?:-[0-9]{{1,3}})?"
        r"| [0-9]{6} [0-9]{4,5}|-[0-9]{6}-[0-9]{4,5})(?![0-9])")
BARE_SECRET = r"(?<![0-9A-Za-z])(?i:token|secret|password|passwd|api[_-]?key)[=:] ?(?=[A-Za-z_\-+/]*+[0-9])[A-Za-z0-9_\-+/=.]{7,}[A-Za-z0-9_\-+/]"
ACCESS_KEY = r"(?<![0-9A-Za-z])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: [A-Z]{0,3}[0-9][A-Z0-9]{0,3}){2,7})(?![0-9A-Za-z])"
IPV6 = (r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:]|\.[0-9])")
NATIONAL = r"(?<![0-9A-Za-z+.\-(])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .\-])[2-9][0-9]{2}[.\-][0-9]{4}(?![0-9A-Za-z]|[.\-][0-9])"
PATTERN = "|".join((SECRET, BARE_SECRET, ACCESS_KEY, EMAIL, PHONE, IPV6, IP, DATE, SSN, NATIONAL))
#: Shapes whose check digits decide.
CHECKED = "|".join((IBAN, CARD))
FOUND = f"{PATTERN}|{CHECKED}"
# The first digits of country codes of one and two digits (other codes have three).
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
NANP = "^[2-9][0-9]{2}[2-9][0-9]{6}$"
#: Steps of a walk back into a set.
WALK = 128
FIRST_DAY, DAYS = "1900-01-01", 73_049


def _hash(key, kind, size, i, half):
    """A 60-bit number from key, kind (a string or a column), size, round and half."""
    raw = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind) if isinstance(kind, str) else kind, size.cast("string"), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(raw, 1, 15), 16, 10).cast("long")


def feistel(a, b, ma, mb, key, kind, size, rounds=ROUNDS):
    """(a, b) below (ma, mb) permuted: a struct of a and b."""
    def step(x, i):
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, (x["a"] + _hash(key, kind, size, i, x["b"])) % ma).otherwise(x["a"]).alias("a"),
            F.when(odd, x["b"]).otherwise((x["b"] + _hash(key, kind, size, i, x["a"])) % mb).alias("b"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(1, rounds + 1)]), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _power(n):
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits, key, kind):
    """A string of 2 to 34 digits permuted among those of its length."""
    def of(d):
        n = F.length(d)
        h = F.floor(n / 2).cast("int")
        a, b = F.substring(d, F.lit(1), h).cast("long"), F.substring(d, h + 1, n).cast("long")
        pair = feistel(a, b, _power(h), _power(n - h), key, kind, n)
        return let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), h, F.lit("0")), F.lpad(p["b"].cast("string"), n - h, F.lit("0"))))

    return let(digits, of)


def luhn_sum(digits, double_last):
    """Sum of the Luhn test; double_last: whether the last digit is one of those doubled."""
    at = F.sequence(F.lit(1), F.length(digits))
    def digit(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == (0 if double_last else 1)
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(at, F.lit(0), lambda s, i: s + digit(i))


def walk(start, once, good):
    """start under the permutation ``once``, again and again until ``good`` holds; start itself after WALK steps in vain."""
    first = F.struct(start.alias("x"), F.lit(False).alias("done"))
    step = lambda s, i: F.when(s["done"], s).otherwise(let(once(s["x"]), lambda y: F.struct(y.alias("x"), good(y).alias("done"))))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, step), lambda s: F.when(s["done"], s["x"]).otherwise(start))


def is_card(d):
    """Whether a string of digits is a card number."""
    return d.rlike(f"^{ISSUER}[0-9]{{9,15}}$") & (luhn_sum(d, False) % 10 == 0)


def permute_card(digits, key):
    """A card number's pseudonym."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    fresh = walk(body, lambda d: permute_digits(d, key, "card"), lambda d: d.rlike(f"^{ISSUER}"))
    return let(fresh, lambda x: F.concat(x, ((10 - luhn_sum(x, True) % 10) % 10).cast("string")))


def _first_groups(m, fine):
    """The length of the longest beginning of m, up to a blank, a hyphen or its end, whose digits and letters are ``fine``; null if none is."""
    ends = F.filter(F.sequence(F.length(m), F.lit(1), F.lit(-1)), lambda i: (i == F.length(m)) | F.substring(m, i + 1, F.lit(1)).isin(" ", "-"))
    good = lambda i: let(F.regexp_replace(F.substring(m, F.lit(1), i), "[ -]", ""), fine)
    return F.get(F.filter(ends, good), F.lit(0))


def _mod97(x):
    """The remainder by 97 of letters and digits, letters counting from 10."""
    def add(s, i):
        code = F.ascii(F.substring(x, i, F.lit(1)))
        return F.when(code < 58, s * 10 + code - 48).otherwise(s * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), add)


def _iban_check(country, account):
    return F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")


def is_iban(x):
    country, account = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
    return F.length(x).between(15, 34) & (F.length(_digits(account)) >= 8) & (F.substring(x, 3, 2) == _iban_check(country, account))


def permute_iban(x, key):
    """An IBAN's pseudonym, without blanks."""
    country, account = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
    kind = F.concat(F.lit("iban"), country, F.regexp_replace(account, "[0-9]", "0"))
    return let(refill(account, permute_digits(_digits(account), key, kind)), lambda a: F.concat(country, _iban_check(country, a), a))


def refill_all(shape, fresh):
    """shape with its letters and digits replaced, in order, by those of ``fresh``; blanks and hyphens stay."""
    at = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[ -]", ""))
    one = lambda i: let(F.substring(shape, i, F.lit(1)), lambda c: F.when(c.isin(" ", "-"), c).otherwise(F.substring(fresh, at(i), F.lit(1))))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")


def permute_national(cc, d, key):
    """The digits behind a country code: permuted, those of the American plan within it and others of its length outside."""
    once = lambda x: permute_digits(x, key, F.concat(F.lit("phone"), cc))
    american = (cc == "1") & (F.length(d) == 10)
    return F.when(american, let(d.rlike(NANP), lambda plan: walk(d, once, lambda x: x.rlike(NANP) == plan))).otherwise(once(d))


def _phone(m, key):
    digits = _digits(m)
    cc = F.when(m.startswith("+"), F.regexp_extract(digits, COUNTRY, 0)).otherwise("1")
    trunk = F.when(m.rlike(r"^\+[0-9]{1,3}[ .\-]?\(0\)"), F.lit("0")).otherwise("")  # "+49 (0)171 ..." is +49 171 ...
    before = F.when(m.startswith("+"), F.concat(cc, trunk)).otherwise("")
    national = F.substring(digits, F.length(before) + 1, F.length(digits))
    fresh = let(F.struct(cc.alias("c"), national.alias("n"), before.alias("b")), lambda x: F.concat(x["b"], permute_national(x["c"], x["n"], key)))
    return F.when(F.length(digits).between(7, 15) & (F.length(national) >= 5), refill(m, fresh)).otherwise(m)


def _ipv6(m, key):
    """The address in full; m itself if it has too many groups."""
    halves, groups = F.split(F.lower(m), "::", 2), lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    gap = 8 - F.size(left) - F.size(right)
    fine = F.when(F.contains(m, F.lit("::")), gap >= 1).otherwise(gap == 0)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    number = lambda x, i: F.conv(F.concat(F.lpad(F.get(x, F.lit(i)), 4, F.lit("0")), F.lpad(F.get(x, F.lit(i + 1)), 4, F.lit("0"))), 16, 10).cast("long")
    word = lambda h: let(F.lower(F.lpad(F.hex(h), 8, F.lit("0"))), lambda x: F.concat(F.substring(x, 1, 4), F.lit(":"), F.substring(x, 5, 4)))
    bits = F.lit(1 << 32)
    half = lambda x, i, kind: let(feistel(number(x, i), number(x, i + 2), bits, bits, key, kind, F.lit(64)), lambda p: F.concat_ws(":", word(p["a"]), word(p["b"])))
    return F.when(fine, let(full, lambda x: F.concat_ws(":", half(x, 0, "network"), half(x, 4, "interface")))).otherwise(m)


def refill(shape, digits):
    """shape with its digits replaced, in order, by those given; separators stay."""
    groups, gaps = F.regexp_extract_all(shape, F.lit("[0-9]+"), F.lit(0)), F.split(shape, "[0-9]+")
    filled = F.aggregate(
        groups, F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), F.lit(1).alias("i")),
        lambda s, g: F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.length(g)), F.get(gaps, s["i"])).alias("out"), (s["at"] + F.length(g)).alias("at"), (s["i"] + 1).alias("i")))
    return F.concat(F.get(gaps, F.lit(0)), filled["out"])


def _digits(x):
    return F.regexp_replace(x, "[^0-9]", "")


def _walk(day, key):
    """A day's number permuted below DAYS: a permutation of 271 x 270 numbers, walked on until below; 16 steps fall short
    with probability 1e-39, and then the number stays out of range, which the caller sees."""
    once = lambda n: let(feistel((n / 270).cast("long"), n % 270, F.lit(271), F.lit(270), key, "date", F.lit(0)), lambda p: p["a"] * 270 + p["b"])
    return F.aggregate(F.array(*[F.lit(i) for i in range(16)]), F.lit(-1).cast("long"), lambda s, i: F.when((i == 0) | (s >= DAYS), once(F.when(i == 0, day).otherwise(s))).otherwise(s))


def pseudonym(m, key=KEY):
    """The pseudonym of a match; the match itself if it isn't valid."""
    iso = (F.when(m.rlike(r"^[0-9]{4}-"), m).when(F.contains(m, F.lit("/")), F.regexp_replace(m, r"^(..)/(..)/(....)$", "$3-$1-$2")).otherwise(F.regexp_replace(m, r"^(..)\.(..)\.(....)$", "$3-$2-$1")))
    style = F.when(m.rlike(r"^[0-9]{4}-"), "yyyy-MM-dd").when(F.contains(m, F.lit("/")), "MM/dd/yyyy").otherwise("dd.MM.yyyy")
    day = F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long")

    def spelled(d):
        fresh = F.date_add(F.lit(FIRST_DAY).cast("date"), d.cast("int"))
        parts = {s: F.date_format(fresh, s) for s in ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy")}
        return F.when(style == "yyyy-MM-dd", parts["yyyy-MM-dd"]).when(style == "MM/dd/yyyy", parts["MM/dd/yyyy"]).otherwise(parts["dd.MM.yyyy"])

    date = F.coalesce(let(_walk(day, key), spelled), m)
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    def address(o):
        pair = feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), F.lit(65536), F.lit(65536), key, "ip", F.lit(32))
        half = lambda h: F.concat_ws(".", F.floor(h / 256).cast("string"), (h % 256).cast("string"))
        return F.when(F.forall(o, lambda x: x < 256), let(pair, lambda p: F.concat_ws(".", half(p["a"]), half(p["b"])))).otherwise(m)

    ssn_shape = "^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"
    ssn = let(_digits(m), lambda d: F.when(d.rlike(ssn_shape), refill(m, walk(d, lambda x: permute_digits(x, key, "ssn"), lambda x: x.rlike(ssn_shape)))).otherwise(m))

    def checked(fine, permute):
        bare = lambda n: F.regexp_replace(F.substring(m, F.lit(1), n), "[ -]", "")
        fresh = lambda n: F.concat(refill_all(F.substring(m, F.lit(1), n), let(bare(n), lambda d: permute(d, key))), F.substring(m, n + 1, F.length(m)))
        return let(_first_groups(m, fine), lambda n: F.when(n.isNull(), m).otherwise(fresh(n)))

    local_part = F.substring_index(m, "@", 1)
    mail = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(m)), 256), 1, 16), F.substring(m, F.length(local_part) + 1, F.length(m)))
    opening = F.regexp_extract(m, "^[A-Za-z_-]+\\s{0,3}[=:]\\s{0,3}[\"']?", 0)
    closing = F.regexp_extract(m, "[\"']?$", 0)
    inner = F.substring(m, F.length(opening) + 1, F.length(m) - F.length(opening) - F.length(closing))
    block = lambda i, x: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), i.cast("string"), x), 256)
    # the first 8 blocks digest the secret, further ones the first block, so that long secrets cost no more than their length
    keyed = lambda x: let(block(F.lit(0), x), lambda first: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(x) / 64).cast("int")), lambda i: block(i, F.when(i < 8, x).otherwise(first))), ""))
    secret = F.concat(opening, let(inner, lambda x: F.substring(keyed(x), F.lit(1), F.length(x))), closing)
    access = F.concat(F.substring(m, 1, 4), F.upper(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("access"), m), 256), 1, 16)))
    return (F.when(m.rlike("^[0-9A-Fa-f]+:[0-9A-Fa-f:]*$"), _ipv6(m, key)).when(m.rlike("^[A-Za-z_-]+\\s{0,3}[=:]"), secret).when(m.rlike(f"^{ACCESS_KEY}$"), access)
            .when(F.contains(m, F.lit("@")), mail).when(m.startswith("+") | m.rlike(f"^{NATIONAL}$"), _phone(m, key)).when(m.rlike("^[A-Z]{2}[0-9]{2}"), checked(is_iban, permute_iban))
            .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), address(octets)).when(m.rlike(f"^(?:{DATE})$"), date).when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ssn)
            .otherwise(checked(is_card, permute_card)))


def protect(df, text="text", key=KEY):
    """df with the text's personal data replaced, plus n_replaced (long)."""
    if text == "n_replaced":
        raise ValueError("n_replaced is the name of the count")
    df = df.drop("n_replaced")
    m, found = free_name(df, "m"), free_name(df, "found")
    has = F.col(text).rlike("[0-9]|@|[\"']|A[KS]IA")
    df = df.withColumn(m, F.when(has, F.regexp_extract_all(F.col(text), F.lit(FOUND), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(found, F.transform(m, lambda x: pseudonym(x, key)))
    pieces = F.zip_with(F.split(F.col(text), FOUND), found, lambda g, x: F.concat(g, F.coalesce(x, F.lit(""))))
    changed = F.size(F.filter(F.arrays_zip(F.col(m).alias("was"), F.col(found).alias("now")), lambda x: x["was"] != x["now"]))
    return df.withColumns({text: F.when(changed > 0, F.array_join(pieces, "")).otherwise(F.col(text)), "n_replaced": F.greatest(changed, F.lit(0)).cast("long")}).drop(m, found)


def query(spark, sf_dir):
    return protect(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs, sf_dir):
    """docs with protected texts and the matching n_chars."""
    return protect(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
