"""Token counts: each distinct pre-token is counted once and joined to its frequencies in the documents."""

from __future__ import annotations

import os
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Text bytes and documents of one block, about.
BLOCK_BYTES, BLOCK_DOCS = 24_000_000, 16_384


class Tokenizer:
    """Splits texts into pre-tokens that are tokenized apart, and counts the tokens of pre-tokens.

    ``.json`` with a byte-level pre-tokenizer: the matches of its pattern, and
    the added special strings, which the library takes out of texts first.
    ``.json`` with another pre-tokenizer and ``.model``: the whole text is one
    pre-token, which is right for any model.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.split: Callable[[str], list[str]] = lambda text: [text]
            self.count: Callable[[list[str]], list[int]] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        import json

        import tokenizers

        model = tokenizers.Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.count = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path) as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        plain = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in made["added_tokens"])
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and made["normalizer"] is None and plain:
            # Fixed value: the pattern of the byte-level pre-tokenizer.
            pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
            special = [a["content"] for a in made["added_tokens"]]
            cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

            def split(text: str) -> list[str]:
                if cut is None or not any(s in text for s in special):
                    return pattern.findall(text)
                out: list[str] = []
                for k, part in enumerate(cut.split(text)):
                    out += [part] if k % 2 else pattern.findall(part)
                return out

            self.split = split
        else:
            self.split = lambda text: [text]


_made: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _made:
        _made[path] = Tokenizer(path)
    return _made[path]


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(struct.pack("<cq", a.dtype.char.encode(), len(a)) + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(packed: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(packed), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<cq", raw, at)
        at += struct.calcsize("<cq")
        out.append(np.frombuffer(raw, np.dtype(kind.decode()), n, at))
        at += out[-1].nbytes
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype("u1")


def _frequencies(path: str, buckets: int, block_bytes: int, block_docs: int):
    """Documents to rows ``block, bucket, payload``: the block's pre-tokens of one bucket, each with its documents and counts there.

    A block's row for bucket -1 holds its documents: ids, which of them are null, bytes.
    """

    def block(number: int, ids: list, texts: list[str], sizes: list[int]) -> list[tuple]:
        split = tokenizer(path).split
        index: dict[str, int] = {}
        doc, piece, count = [], [], []
        for text in texts:
            c = Counter(split(text)) if text else {}
            doc.append(len(c))
            piece.extend([index.setdefault(p, len(index)) for p in c])
            count.extend(c.values())
        rows = [(number, -1, _pack(np.array([i or 0 for i in ids], "i8"), np.array([i is None for i in ids], "u1"), np.array(sizes, "i8")))]
        if not index:
            return rows
        raw = [p.encode("utf-8", "surrogatepass") for p in index]
        bucket = np.fromiter((zlib.crc32(p) for p in raw), "u4", len(raw)) % buckets
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), "i4")
        rank[order] = np.arange(len(order))
        of = rank[np.array(piece, "i4")]
        posts = np.argsort(of, kind="stable")
        docs = np.repeat(np.arange(len(doc), dtype="i4"), doc)[posts]
        counts = np.array(count, "i4")[posts]
        per = np.bincount(of, minlength=len(raw))
        ends = np.concatenate([[0], np.cumsum(per)])
        lengths = np.fromiter((len(raw[i]) for i in order), "i4", len(raw))
        found, firsts = np.unique(bucket[order], return_index=True)
        for b, lo, hi in zip(found.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(raw)], strict=True):
            text = np.frombuffer(b"".join(raw[i] for i in order[lo:hi]), "u1")
            rows.append((number, b, _pack(text, _narrow(lengths[lo:hi]), _narrow(per[lo:hi]), _narrow(docs[ends[lo] : ends[hi]]), _narrow(counts[ends[lo] : ends[hi]]))))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, sizes, held = [], [], [], 0

        def flush():
            rows = block(number, ids, texts, sizes)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "bucket", "payload"])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                t = t.as_py() or ""
                ids.append(i)
                texts.append(t)
                sizes.append(len(t.encode()))
                held += sizes[-1]
                if held >= block_bytes or len(ids) >= block_docs:
                    yield flush()
                    number += 1
                    ids, texts, sizes, held = [], [], [], 0
        if ids:
            yield flush()

    return run


def _count_bucket(path: str):
    """Rows of some buckets to rows ``block, payload`` with the tokens that the bucket's pre-tokens add to the block's documents.

    The counts of distinct pre-tokens are kept, so each is tokenized once: all
    rows that hold it are in this partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            blocks, sums = [], []
            for number, bucket, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                blocks.append(number)
                if bucket < 0:
                    sums.append((True, payload))
                    continue
                text, lengths, per, docs, counts = _unpack(payload)
                raw, ends = text.tobytes(), np.cumsum(lengths, dtype="i8").tolist()
                each = [raw[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
                new = [p for p in each if p not in known]
                known.update(zip(new, tokenizer(path).count([p.decode("utf-8", "surrogatepass") for p in new]), strict=True))
                tokens = np.fromiter((known[p] for p in each), "i8", len(each))
                total = np.bincount(docs, weights=np.repeat(tokens, per) * counts.astype("i8")).astype("i8")
                sums.append((False, _pack(_narrow(total))))
            yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int64()), "head": pa.array([h for h, _ in sums], pa.bool_()), "payload": pa.array([p for _, p in sums], pa.binary())})

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block, its head first: one row per document."""
    at, head, total = None, None, None

    def out():
        ids, null, sizes = head
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(sizes), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if block != at:
                if at is not None:
                    yield out()
                at, head = block, _unpack(payload)
                total = np.zeros(len(head[0]), "i8")
            else:
                (part,) = _unpack(payload)
                total[: len(part)] += part
    if at is not None:
        yield out()


def token_counts(docs: DataFrame, path: str, limit: int = 1024, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text of ``docs(doc_id, text)``.

    Blocks of documents list their distinct pre-tokens with the documents and
    frequencies; the lists are hashed to as many buckets as the session has
    shuffle partitions, so all lists with a pre-token meet in one task, which
    counts it once and sums count times frequency for the block's documents.
    A last shuffle adds up the sums of each block.  Ids are never materialised.
    Common pre-tokens cost one entry per block, so none makes a task hot.

    Null texts count as empty ones: 0 bytes, 0 tokens.  Null and repeated ids
    are rows like others, other columns are left out, no rows give none.  Texts
    are whole however long: one longer than ``block_bytes`` is a block.
    """
    buckets = partitions(docs.sparkSession)
    lists = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_frequencies(path, buckets, block_bytes, block_docs), "block long, bucket int, payload binary")
    # The documents' own rows go by block, not to a bucket.
    place = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("block"), F.lit(buckets))).otherwise(F.col("bucket"))
    dealt = lists.repartitionById(buckets, place.cast("int"))
    sums = dealt.mapInArrow(_count_bucket(path), "block long, head boolean, payload binary")
    blocks = sums.repartition(buckets, "block").sortWithinPartitions("block", F.col("head").desc())
    counted = blocks.select("block", "payload").mapInArrow(_add_up, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
