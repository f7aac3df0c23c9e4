"""Tree-reduced BPE against the library, whole texts at once."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotgraph.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def small():
    return bpe.Codec(bpe.load_ranks(PATH), PATTERN, leaf=5, piece_leaf=4)


CODEC = bpe.Codec(bpe.load_ranks(PATH), PATTERN, leaf=5, piece_leaf=4)
TEXT = st.one_of(
    st.text(max_size=120),
    st.text(alphabet="ab '\n\t s19.,é 字", max_size=200),
    st.text(alphabet="abcdeths", max_size=300),
    st.lists(st.sampled_from(["the", " and", "'s", "'re", "  ", "\n", "1234", "!?", "字", "tion", "é"]), max_size=60).map("".join),
)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_tree_equals_library(text):
    ids = CODEC.encode(text)
    assert ids == CODEC.encoding.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=200), st.integers(1, 199))
def test_pieces_join_anywhere(piece, at):
    at = min(at, len(piece))
    left, right = CODEC._merge(piece[:at]) if at else [], CODEC._merge(piece[at:]) if at < len(piece) else []
    if left and right:
        assert CODEC.join_piece(left, right) == CODEC._merge(piece)


def test_long_single_run_and_edges(small):
    for text in ("a" * 5000, "ab" * 3000, " " * 3000 + "x", "\n" * 999, "", "x", "字" * 700, "9" * 2000):
        assert small.encode(text) == small.encoding.encode_ordinary(text)


def test_blanks_and_marks_around_every_seam(small):
    """Texts whose halves part inside blanks, contractions, line ends and marks."""
    for middle in ("\n   \n", " \n \n x", "   's", "'re", "\r\n\r\n", "1234 56", "...\n\n", "\u3000\u3000a", " " * 9000 + "\n", "\n" * 50 + " " * 50 + "b"):
        for pad in range(12):
            text = "a" * pad + middle + "bc d" * 3
            assert small.encode(text) == small.encoding.encode_ordinary(text), text


def test_a_million_characters_without_a_space():
    """One match of the pattern, or many without blanks between, in a time near the library's."""
    import random
    import time

    rng = random.Random(1)
    codec = bpe.codec(PATH, PATTERN)
    for text in ("".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(1_000_000)), "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))):
        began = time.process_time()
        want = codec.encoding.encode_ordinary(text)
        plain = time.process_time() - began
        began = time.process_time()
        assert codec.encode(text) == want
        assert time.process_time() - began < 3 * plain + 2


def test_encode_decode_rows(spark):
    rows = [(1, "The cat's  hat.\n", "x"), (2, None, "x"), (3, "", None), (None, "word " * 9000, "x"), (1, "The cat's  hat.\n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(docs, PATH, PATTERN, leaf=64), PATH, PATTERN).collect()
    assert len(out) == 5
    for r in out:
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert r["ids"] == CODEC.encoding.encode_ordinary(r["text"] or "")
    key = lambda rs: sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in rs)
    assert key(bpe.encode_and_decode(docs, PATH, PATTERN, leaf=64).collect()) == key(out)
    assert bpe.round_trip(docs, PATH, PATTERN, leaf=64).filter("not round_trip").count() == 0
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
