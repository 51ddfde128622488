"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries before the library sees them. A cut before white space that follows a
non-space is safe: no alternative of the pattern spans such a place, and the pattern's only lookahead is at the end
of white space. A very long run of white space would exhaust the regex engine's backtracking, so it is handed over
as what the pattern makes of it: all but its last character (all of it at the end of the text) as one piece.

Edge cases: a null text counts as empty; an empty text has no ids and decodes to no bytes; texts of special tokens
are ordinary text; equal texts give equal rows; an empty table gives no rows; other columns pass through
``encode`` and ``decode`` unchanged, and the new column replaces one of its name.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import re
import sys

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadmill.llm.common import small_batches, table

NAME = "op10_bpe"
RANKS = "byte_bpe_50k.tiktoken"
#: Texts are cut into pieces of about so many characters.
PIECE_CHARS = 1 << 16
#: White space as the library's pattern knows it; Python's \\s also has four separators, which it counts as marks.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
_RUN = re.compile(f"(?<![{_WHITE}])[{_WHITE}]{{4096,}}(?![{_WHITE}])")


@functools.lru_cache(maxsize=4)
def load(path: str, pattern: str):
    """The tiktoken encoding of a rank file; once in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS):
    """(text, whole) pieces whose concatenation is the text; whole ones are one match of the pattern."""
    if len(text) <= size:
        yield text, False
        return
    at = 0
    for run in [*_RUN.finditer(text), None]:
        end = run.start() if run else len(text)
        while end - at > size:
            cut = _CUT.search(text, at + size, end)
            stop = cut.start() if cut and cut.start() < end else end
            yield text[at:stop], False
            at = stop
        if at < end:
            yield text[at:end], False
        if run:
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[end:at], True


def encode_text(enc, text: str | None) -> list[int]:
    """Ids of a whole text."""
    ids: list[int] = []
    for piece, whole in pieces(text or ""):
        ids += enc._encode_single_piece(piece) if whole else enc.encode_ordinary(piece)
    return ids


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def decode_ids(enc, ids: list[int]) -> bytes:
    """Raw bytes of ids; they need not be valid UTF-8."""
    return enc.decode_bytes(ids)


def encode(df, text="text", out="ids", path=None, pattern=public_tokenizers.PATTERN):
    """df with the ids of each text in column ``out`` (array of int)."""
    path = path or public_tokenizers.path(RANKS)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        enc = load(path, pattern)
        return pd.Series([np.asarray(encode_text(enc, t), dtype="int32") for t in texts], dtype=object)

    return df.withColumn(out, ids(F.col(text).cast("string")))


def decode(df, ids="ids", out="decoded", path=None, pattern=public_tokenizers.PATTERN):
    """df with the bytes of each array of ids in column ``out`` (binary)."""
    path = path or public_tokenizers.path(RANKS)

    @F.pandas_udf(T.BinaryType())
    def raw(arrays: pd.Series) -> pd.Series:
        enc = load(path, pattern)
        return pd.Series([decode_ids(enc, a.tolist() if a is not None else []) for a in arrays], dtype=object)

    return df.withColumn(out, raw(F.col(ids)))


def digests(df, text="text", path=None, pattern=public_tokenizers.PATTERN):
    """df with struct column ``bpe``: n_tokens, ids_sha256, decoded_sha256. One pass: the ids do not leave the worker."""
    path = path or public_tokenizers.path(RANKS)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: pd.Series) -> pd.DataFrame:
        enc, rows = load(path, pattern), []
        for t in texts:
            ids = encode_text(enc, t)
            rows.append((len(ids), hashlib.sha256(id_bytes(ids)).hexdigest(), hashlib.sha256(decode_ids(enc, ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.withColumn("bpe", both(F.col(text).cast("string")))


def query(spark, sf_dir):
    return of(spark, table(spark, sf_dir, "documents"))


def of(spark, docs):
    small_batches(spark)
    return digests(docs.select("doc_id", "text")).select("doc_id", "bpe.*")


def stage(spark, docs, sf_dir):
    """Per document: doc_id, n_tokens, ids, and whether the decoded ids are the text again."""
    small_batches(spark)
    tokens = decode(encode(docs.select("doc_id", "text")))
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))
