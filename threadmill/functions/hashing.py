"""Digests and perceptual distances as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.functions.text import col


def content_hash(x):
    """SHA-256 of the whole content."""
    return F.sha2(col(x), 256)


def hamming64(a, b):
    """Number of bits in which two 64-bit hashes differ."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def hash_hex(x):
    """A 64-bit hash as sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(col(x)), 16, "0"))


def participant_signature(participants):
    """Lower-cased names in order, joined; empty if there are none."""
    names = F.filter(F.transform(col(participants), lambda p: F.lower(p)), lambda p: p != "")
    return F.array_join(F.array_sort(names), "\x1f")
