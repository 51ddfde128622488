"""Reactions and attachments of a raw message, as column expressions over its nested arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.functions.text import clean_text, col, is_blank, safe_str, uri_filename
from threadmill.schema import DETAIL

# The order of the kinds, and how each is worded with and without file names.
MEDIA_KINDS = (
    ("photos", "photo", "photo(s)", "photo(s)"),
    ("videos", "video", "video(s)", "video(s)"),
    ("audio_files", "audio", "audio", "audio file(s)"),
    ("files", "file", "file(s)", "file(s)"),
    ("gifs", "gif", "gif(s)", "gif(s)"),
)


def reaction_summary(reactions, entities: bool = False):
    """``reaction by actor`` or the bare reaction, joined; those without a reaction are left out."""
    clean = lambda x: clean_text(x, entities=entities)
    parts = F.transform(col(reactions), lambda r: F.struct(clean(r["reaction"]).alias("rx"), clean(r["actor"]).alias("by")))
    worded = F.transform(F.filter(parts, lambda p: p["rx"] != ""), lambda p: F.when(p["by"] != "", F.concat(p["rx"], F.lit(" by "), p["by"])).otherwise(p["rx"]))
    return F.coalesce(F.array_join(worded, "; "), F.lit(""))


def _none():
    return F.array().cast("array<string>")


def _list_summary(media, named, bare):
    count = F.size(media).cast("string")
    names = F.filter(F.transform(media, lambda m: uri_filename(m["uri"])), lambda n: n != "")
    worded = F.when(F.size(names) > 0, F.concat(count, F.lit(f" {named}: "), F.array_join(names, ", "))).otherwise(F.concat(count, F.lit(f" {bare}")))
    return F.when(F.size(media) > 0, F.array(worded)).otherwise(_none())


def _is_object(x):
    return F.coalesce(x.rlike(r"\A\s*\{"), F.lit(False))


def _has_sticker(x):
    """A JSON value that Python takes for true."""
    return x.isNotNull() & ~F.trim(x).isin("", "null", "false", "0", "0.0", "{}", "[]")


def attachment_summary(message):
    """One phrase for each kind of attachment, in fixed order."""
    m = col(message)
    share = m["share"]
    link = F.coalesce(F.get_json_object(share, "$.link"), F.lit(""))
    bits = [_list_summary(m[field], named, bare) for field, _, named, bare in MEDIA_KINDS]
    bits.append(F.when(_has_sticker(m["sticker"]), F.array(F.lit("sticker"))).otherwise(_none()))
    bits.append(F.when(_is_object(share), F.array(F.when(link != "", F.concat(F.lit("share: "), link)).otherwise("share"))).otherwise(_none()))
    return F.array_join(F.concat(*bits), "; ")


def _detail(**given):
    return F.struct(*[given.get(f.name, F.lit(None)).cast("string").alias(f.name) for f in DETAIL])


def attachment_details(message):
    """A struct for each attachment, in the order of the summary; keys that a kind lacks are null, texts are as they came."""
    m = col(message)

    def media(field, kind):
        def one(x):
            keys = {"type": F.lit(kind), "uri": safe_str(x["uri"])}
            if kind != "gif":
                keys["filename"] = uri_filename(x["uri"])
            if kind == "video":
                keys["thumbnail"] = safe_str(x["thumbnail"]["uri"])
            return _detail(**keys)

        return F.coalesce(F.transform(m[field], one), F.array().cast(f"array<{DETAIL.simpleString()}>"))

    none = F.array().cast(f"array<{DETAIL.simpleString()}>")
    sticker, share = m["sticker"], m["share"]
    link = F.nullif(F.get_json_object(share, "$.link"), F.lit(""))
    parts = [media(field, kind) for field, kind, _, _ in MEDIA_KINDS]
    uri = F.when(_is_object(sticker), F.coalesce(F.get_json_object(sticker, "$.uri"), F.lit(""))).otherwise("")
    parts.append(F.when(_has_sticker(sticker), F.array(_detail(type=F.lit("sticker"), uri=uri))).otherwise(none))
    parts.append(F.when(_is_object(share), F.array(_detail(type=F.lit("share"), link=link, text=F.coalesce(F.get_json_object(share, "$.share_text"), F.lit(""))))).otherwise(none))
    return F.concat(*parts)


def has_payload(content, reactions, attachments):
    """A message counts if it has a text, an attachment or a reaction."""
    return ~(is_blank(content) & is_blank(attachments) & is_blank(reactions))
