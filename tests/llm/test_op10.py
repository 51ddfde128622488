import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm import op10_bpe as op

ENC = op.load(public_tokenizers.path(op.RANKS), public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\t'sé漢  .😀"), max_size=200), st.integers(1, 20))
def test_cuts_do_not_change_ids(text, size):
    ids = [i for p, whole in op.pieces(text, size) for i in (ENC._encode_single_piece(p) if whole else ENC.encode_ordinary(p))]
    assert ids == ENC.encode_ordinary(text)
    assert op.decode_ids(ENC, ids) == text.encode()


@pytest.mark.parametrize("text", ["a" + " " * 5000 + "b", "a" + "\n" * 5000 + "b", "a" + " " * 5000, " " * 5000 + "x", "<|endoftext|>" * 3])
def test_long_runs(text):
    ids = [i for p, whole in op.pieces(text, 100) for i in (ENC._encode_single_piece(p) if whole else ENC.encode_ordinary(p))]
    assert ids == ENC.encode_ordinary(text)


def test_very_long_run_does_not_break():
    text = "a" + " " * 1_500_000 + "b"
    assert op.decode_ids(ENC, op.encode_text(ENC, text)) == text.encode()


def test_rows(spark):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", None), (4, "hello world", "z"), (None, "née", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in op.of(spark, df).collect()}
    assert len(got) == 5
    want = ENC.encode_ordinary("hello world")
    assert got[1].n_tokens == len(want)
    assert got[1].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    assert got[2].n_tokens == got[3].n_tokens == 0
    assert got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert op.of(spark, df.limit(0)).count() == 0


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(1, "naïve 12  x\n"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.decoded) for r in op.decode(op.encode(df)).collect()}
    assert got == {1: "naïve 12  x\n".encode(), 2: b""}


WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2007\u200a\u2028\u2029\u202f\u205f\u3000"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1!." + WHITE + "\x1c\x1d\x1e\x1f\u200b\u180e\ufeff"), max_size=200), st.integers(1, 20))
def test_cuts_at_any_blank(text, size):
    ids = [i for p, whole in op.pieces(text, size) for i in (ENC._encode_single_piece(p) if whole else ENC.encode_ordinary(p))]
    assert ids == ENC.encode_ordinary(text)


@pytest.mark.parametrize("run", [*(c * 5000 for c in WHITE), (WHITE * 500)[:5000]])
def test_long_runs_of_any_blank(run):
    for text in (f"a{run}b", f"a{run}", f"{run}1", f"!{run} b"):
        ids = [i for p, whole in op.pieces(text, 100) for i in (ENC._encode_single_piece(p) if whole else ENC.encode_ordinary(p))]
        assert ids == ENC.encode_ordinary(text)


def test_very_long_runs_of_any_blank_through_the_query(spark):
    texts = [f"a{run}b" for run in ("\u3000" * 1_500_000, "\xa0" * 1_500_000, "\x85" * 1_500_000, " \u3000\n\u2003" * 400_000)] + ["x" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op.of(spark, df).collect():
        text = texts[r.doc_id]
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        if len(text) > 1_000_000:
            want = ENC.encode_ordinary("a") + ENC._encode_single_piece(text[1:-2]) + ENC.encode_ordinary(text[-2:])
            assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(op.id_bytes(want)).hexdigest())
