"""Ranked lexical search: MaxScore in every shard of the documents.

A shard is a batch of documents with its own postings of the queries' terms.
For each query, terms are ordered by the highest score that one of the shard's
documents has from them.  Terms whose bounds together can't lift a document to
the shard's k-th best score are non-essential: only documents of the other
terms are candidates, and non-essential postings are probed, from the highest
bound down, while a candidate can still qualify.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, rename_clashes, written

#: Everything but ASCII letters, digits and characters beyond ASCII separates terms.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of a shard, documents that are scored at once, and queries of a pass.
SHARD, STEP, QUERIES = 50_000, 4_096, 2_000


def terms_of(text: Column) -> Column:
    """The terms of a text in order; none of a null."""
    parts = F.split(F.translate(text, UPPER, LOWER), BREAKS)
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))


def _tallies(counted: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' offsets, terms and frequencies of a column of ``array<struct<term:int, tf:int>>``."""
    flat = counted.flatten()
    at = counted.offsets.to_numpy() - counted.offsets[0].as_py()
    return at, flat.field("term").to_numpy(zero_copy_only=False), flat.field("tf").to_numpy(zero_copy_only=False)


def counting(terms: dict[str, int]):
    """A function for mapInArrow: ``doc_id, n, found`` of ``doc_id, terms``, where ``found`` has the queries' terms and how often each occurs."""
    kind = pa.list_(pa.struct([("term", pa.int32()), ("tf", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(list(terms), pa.string())
        numbers = np.array(list(terms.values()), "i4")
        for batch in batches:
            column = batch.column("terms")
            flat, at = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
            hits = pa.compute.index_in(flat, known).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
            there = ~np.isnan(hits) if hits.dtype.kind == "f" else np.ones(len(hits), bool)
            pairs, tf = np.unique(doc[there] * np.int64(len(numbers) or 1) + numbers[hits[there].astype("i8")] if there.any() else np.empty(0, "i8"), return_counts=True)
            owner, term = pairs // (len(numbers) or 1), (pairs % (len(numbers) or 1)).astype("i4")
            offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype("i4")
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(term), pa.array(tf.astype("i4"))], names=["term", "tf"])).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at).astype("i8")), found], names=["doc_id", "n", "found"])

    return run


def max_score(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of the ``k`` best documents, ties to smaller ``ids``, and how many postings were read.

    ``lists`` has for each term the documents (positions, ascending) and the
    scores that it gives them.
    """
    bounds = np.array([s.max() for _, s in lists], "i8")
    order = np.argsort(bounds, kind="stable")
    lists, bounds = [lists[i] for i in order], bounds[order]
    # What the terms up to and with each one can add together.
    reach = np.cumsum(bounds)
    best_at, best = np.empty(0, "i8"), np.empty(0, "i8")
    read = 0
    for low in range(0, len(ids), STEP):
        least = best[-1] if len(best) == k else 1
        # A document of non-essential terms alone stays under the least score.
        first = int(np.searchsorted(reach, least))
        if first == len(lists):
            break
        score, seen = np.zeros(STEP, "i8"), np.zeros(STEP, bool)
        for docs, gains in lists[first:]:
            a, b = np.searchsorted(docs, (low, low + STEP))
            score[docs[a:b] - low] += gains[a:b]
            seen[docs[a:b] - low] = True
            read += b - a
        rows = np.flatnonzero(seen)
        for t in range(first - 1, -1, -1):
            rows = rows[score[rows] + reach[t] >= least]
            if not len(rows):
                break
            docs, gains = lists[t]
            at = np.searchsorted(docs, rows + low)
            hit = (at < len(docs)) & (docs[np.minimum(at, len(docs) - 1)] == rows + low)
            score[rows[hit]] += gains[at[hit]]
            read += len(rows)
        rows = rows[score[rows] >= least]
        best_at, best = np.append(best_at, rows + low), np.append(best, score[rows])
        top = np.lexsort((ids[best_at], -best))[:k]
        best_at, best = best_at[top], best[top]
    return best_at, best, read


def searching(queries: list[tuple[int, list[int], list[int]]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """A function for mapInArrow over ``doc_id, n, found``: ``query, doc_id, score`` of the ``k`` best documents of each shard for each of ``queries(number, terms, repeats)``."""

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        at, term, tf = _tallies(table.column("found").chunk(0))
        n = table.column("n").to_numpy()
        real = table.column("doc_id")
        # Null ids come after all others.
        ids = np.lexsort((pa.compute.fill_null(real, 0).to_numpy(), np.asarray(real.is_null()))).argsort()
        doc = np.repeat(np.arange(len(n)), np.diff(at))
        damp = 100 - 75 + (75 * n * n_docs) // max(n_terms, 1)
        gain = (1_000_000_000 * tf.astype("i8")) // (1000 * tf.astype("i8") + 8 * damp[doc])
        order = np.argsort(term, kind="stable")
        term, doc, gain = term[order], doc[order], gain[order] * weights[term[order]]
        starts = np.searchsorted(term, np.arange(len(weights) + 1))
        numbers, docs, scores = [], [], []
        for number, parts, repeats in queries:
            lists = [(doc[starts[t] : starts[t + 1]], gain[starts[t] : starts[t + 1]] * r) for t, r in zip(parts, repeats) if starts[t] < starts[t + 1] and weights[t] > 0]
            if lists:
                found, score, _ = max_score(lists, ids, k)
                numbers.append(np.full(len(found), number, "i8"))
                docs.append(found)
                scores.append(score)
        none = [np.empty(0, "i8")]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers or none)), real.take(pa.array(np.concatenate(docs or none))).combine_chunks(), pa.array(np.concatenate(scores or none))], names=["query", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD:
                yield shard(held)
                held = []
        if sum(b.num_rows for b in held):
            yield shard(held)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents ``docs(doc_id, text)`` that score highest for each of ``items(item_id, text)``.

    Scores are above zero; equal scores go by ascending id, ids that are null
    last.  Repeated rows of documents are documents each; an item is an id and
    a text, and one without terms has no rows.  Null texts have no terms.
    Texts are whole however long.  Empty tables give no rows; other columns
    are left out.

    The queries are taken in blocks of QUERIES, whose terms go to all shards.
    The postings of a block's terms are written once: their statistics and the
    search both read them.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", "text").distinct()
    asked = cut(asked.select("item_id", terms_of(F.col("text")).alias("terms"), F.xxhash64("text").alias("h")).filter(F.size("terms") > 0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), terms_of(F.col("text")).alias("terms"))
    blocks = -(-asked.count() // QUERIES)
    found: DataFrame | None = None
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "h"), F.lit(blocks)) == block)
        part = _block(spark, texts, mine, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return found


def _block(spark, texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    rows = asked.collect()  # a block of queries
    terms = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
    queries = []
    for number, r in enumerate(rows):
        parts, repeats = np.unique([terms[t] for t in r["terms"]], return_counts=True)
        queries.append((number, parts.tolist(), repeats.tolist()))
    postings, _ = written(texts.mapInArrow(counting(terms), "doc_id long, n long, found array<struct<term:int,tf:int>>"), "postings")
    totals = postings.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["n"], totals["terms"] or 0
    df = {r["term"]: r["df"] for r in postings.select(F.explode("found.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # terms of a block of queries
    weights = np.array([int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))) for t in range(len(terms))], "i8")
    hits = postings.filter(F.size("found") > 0).mapInArrow(searching(queries, weights, n_docs, n_terms, k), "query long, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"query long, item_id {asked.schema['item_id'].dataType.simpleString()}")
    return rename_clashes(ranked, ["item_id"]).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
