"""The fixed schemas: what an export file may hold, and the rows that every operator works on."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields):
    s = T.StructType()
    for name, kind in fields.items():
        s = s.add(name, kind)
    return s


STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()
STRINGS = T.ArrayType(STRING)
MEDIA = T.ArrayType(_struct(uri=STRING, thumbnail=_struct(uri=STRING)))

#: One message of an export. Fields whose type varies arrive as the text of their JSON.
RAW_MESSAGE = _struct(
    sender_name=STRING, senderName=STRING, timestamp_ms=STRING, timestamp=STRING, content=STRING, text=STRING,
    reactions=T.ArrayType(_struct(reaction=STRING, actor=STRING)),
    photos=MEDIA, videos=MEDIA, audio_files=MEDIA, files=MEDIA, gifs=MEDIA, sticker=STRING, share=STRING)
#: One export file. Participants may be objects or strings.
EXPORT = _struct(title=STRING, threadName=STRING, participants=STRINGS, messages=T.ArrayType(RAW_MESSAGE))

DETAIL = _struct(type=STRING, uri=STRING, filename=STRING, thumbnail=STRING, link=STRING, text=STRING)
#: A cleaned message. (timestamp_ms, file_seq, msg_idx) orders a thread; source_seq and thread_key order and name threads.
MESSAGES = _struct(
    thread_key=STRING, source_id=STRING, source_seq=INT, file_seq=LONG, msg_idx=LONG, timestamp_ms=LONG, ts=T.TimestampType(), dt_iso=STRING,
    sender=STRING, content=STRING, reactions=STRING, attachments=STRING, attachment_details=T.ArrayType(DETAIL))
#: A thread: its messages are those of its thread_key.
THREADS = _struct(thread_key=STRING, source_id=STRING, source_seq=INT, thread_seq=INT, title=STRING, participants=STRINGS)
#: What could not be read, and why.
REJECTS = _struct(path=STRING, thread_key=STRING, stage=STRING, error=STRING)

ORDER = ("timestamp_ms", "file_seq", "msg_idx")
