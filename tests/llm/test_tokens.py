"""Token counts against the libraries on whole texts."""

import public_tokenizers
import pytest

from plotgraph.llm import tokens

TEXTS = [None, "", "a", "The  cat's hat\n\n x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "é字 ½ 12 3.4\t\t", "long " * 5000, "a" * 3000, "The  cat's hat\n\n x", "  lead and trail  "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_library(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    docs = spark.createDataFrame([(i if i else None, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string").repartition(3)
    got = sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3]) for r in tokens.token_counts(docs, path, limit=10, block_docs=2).collect())
    want = [(i or -1, len((t or "").encode()), count(t or ""), count(t or "") > 10) for i, t in enumerate(TEXTS)]
    assert got == sorted(want)
    assert tokens.token_counts(docs.limit(0), path).count() == 0


def test_very_long_text(spark):
    """A text larger than a block, beside short ones."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["The cat's hat. " * 60_000, "short", "The cat's hat. "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.token_counts(docs, path, block_bytes=1000).collect()}
    assert got == {i: (len(t), len(library.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)}
