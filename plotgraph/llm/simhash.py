"""SimHash near-duplicates by self-joins of binary tries."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces
from .common import cut, rename_clashes, set_aside
from .components import connected_components, local_roots
from .groups import by_groups, deal_pairs, spread_join

BITS = 64
#: Pairs of trie nodes with at most so many pairs of leaves are compared leaf by leaf.
LEAF_PAIRS = 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included, as a signed 64-bit number.

    Words lie between space, \\t, \\n, \\v, \\f and \\r; A-Z are lower-cased.
    Fewer words than a shingle: the whole sequence.  No words: 0.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return int(np.uint64(digest(joined, seed)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, found), "i8", len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    lo, hi = starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(lo, hi, strict=True)], "u8", len(lo))
    ones = np.zeros(BITS, "i8")
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, name: str = "fp", words: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` without its text, with ``name``: the fingerprint of the whole text as a long."""
    docs = rename_clashes(docs, [name])
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != "text"], T.StructField(name, T.LongType())])

    def run(batches):
        for batch in pieces(batches, "text"):
            made = pa.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], pa.int64())
            rest = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], made], names=[*[batch.schema.names[i] for i in rest], name])

    return docs.mapInArrow(run, schema)


def _layout(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks that the bits are cut into."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return [(lo, hi - lo) for lo, hi in itertools.pairwise(edges)]


def _turned(fp: np.ndarray, chosen: tuple[int, ...], layout: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """The bits of the chosen blocks, the other bits, and how many those are."""
    key, rest, free = np.zeros(len(fp), "u8"), np.zeros(len(fp), "u8"), 0
    for k, (shift, width) in enumerate(layout):
        part = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        if k in chosen:
            key = (key << np.uint64(width)) | part
        else:
            rest = (rest << np.uint64(width)) | part
            free += width
    return key, rest, free


def trie_join(value: np.ndarray, roots: list[tuple[np.ndarray, ...]], free: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, enough to connect all rows that differ in ``budget`` bits or fewer.

    ``value`` holds ``free`` bits per row, sorted within each root of a trie;
    a node is a range of rows.  ``roots`` are pairs of nodes to begin with:
    arrays of the first and end rows of the two, and whether they are the same
    node.  All pairs of nodes go down a bit at a time: pairs of unlike children
    have one more differing bit, and are dropped beyond the budget.  A pair
    with few leaves is compared leaf by leaf; a pair whose bits left can't
    exceed the budget is connected without looking further.
    """
    a0, a1, b0, b1, same = roots
    d = np.zeros(len(a0), "i8")
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def leaves(a0, a1, b0, b1, same):
        na, nb = a1 - a0, b1 - b0
        total = na * nb
        at = np.repeat(np.arange(len(total)), total)
        k = np.arange(len(at)) - np.repeat(np.cumsum(total) - total, total)
        x, y = a0[at] + k // nb[at], b0[at] + k % nb[at]
        keep = (np.bitwise_count(value[x] ^ value[y]) <= budget) & (~same[at] | (x < y))
        found.append((x[keep], y[keep]))

    for p in range(free - 1, -1, -1):
        keep = (d <= budget) & (a1 > a0) & (b1 > b0) & ~(same & (a1 - a0 < 2))
        a0, a1, b0, b1, same, d = (x[keep] for x in (a0, a1, b0, b1, same, d))
        if not len(a0):
            break
        sure = d + p + 1 <= budget
        if sure.any():
            for lo, hi, of in ((a0[sure], a1[sure], b0[sure]), (b0[sure], b1[sure], a0[sure])):
                n = hi - lo
                x = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append((x, np.repeat(of, n)))
        few = ~sure & ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS)
        if few.any():
            leaves(*(x[few] for x in (a0, a1, b0, b1, same)))
        on = ~sure & ~few
        a0, a1, b0, b1, same, d = (x[on] for x in (a0, a1, b0, b1, same, d))
        if not len(a0):
            break
        zeros = np.concatenate([[0], np.cumsum((value >> np.uint64(p)) & np.uint64(1) == 0)])
        ma, mb = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
        unlike = ~same
        a0, a1, b0, b1, d, same = (
            np.concatenate(x)
            for x in (
                (a0, ma, a0, ma[unlike]),
                (ma, a1, ma, a1[unlike]),
                (b0, mb, mb, b0[unlike]),
                (mb, b1, b1, mb[unlike]),
                (d, d, d + 1, d[unlike] + 1),
                (same, same, np.zeros(len(same), bool), np.zeros(unlike.sum(), bool)),
            )
        )
    else:  # rows that are equal in all bits
        keep = (d <= budget) & (a1 > a0) & (b1 > b0)
        if keep.any():
            leaves(*(x[keep] for x in (a0, a1, b0, b1, same)))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, "i8") for i in (0, 1))


def links(fps: DataFrame, budget: int = 4, blocks: int | None = None) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints, enough to connect all that differ in ``budget`` bits or fewer.

    The bits are cut into ``blocks`` (budget + 1 if not given).  Two
    fingerprints within the budget agree in ``blocks - budget`` blocks at
    least, so for every choice of that many blocks the fingerprints with equal
    bits there form a trie of their other bits, which is joined with itself.
    More blocks give more and smaller tries; the result is the same.  Large
    tries are cut and joined in pairs of parts, so no task grows with them.
    """
    blocks = blocks or budget + 1
    layout = _layout(blocks)
    choices = list(itertools.combinations(range(blocks), blocks - budget))

    def turn(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for k, chosen in enumerate(choices):
                key, _, _ = _turned(fp.view("u8"), chosen, layout)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), k, "i4")), pa.array(key.view("i8")), pa.array(fp)], names=["trie", "prefix", "fp"])

    def work(rows, starts):
        fp, part = rows["fp"].astype("i8"), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        out = []
        for k in np.unique(rows["trie"]):
            of = rows["trie"] == k
            mine, side = fp[of], rows["_side"][of]
            _, rest, free = _turned(mine.view("u8"), choices[k], layout)
            order = np.lexsort((rest, side, part[of]))
            mine, rest, side, group = mine[order], rest[order], side[order], part[of][order]
            first = np.append(np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (side[1:] != side[:-1]))), len(mine))
            lo, hi = first[:-1], first[1:]
            two = np.append(group[lo[1:]] == group[lo[:-1]], False)  # this range is one side, the next the other
            second = np.append(False, two[:-1])
            alone = (rows["_lo"] == rows["_hi"])[of][order][lo] & ~second
            a0, a1 = lo[alone | two], hi[alone | two]
            n = np.flatnonzero(alone | two)
            nxt = np.minimum(n + 1, len(lo) - 1)
            b0, b1 = np.where(alone[n], a0, lo[nxt]), np.where(alone[n], a1, hi[nxt])
            x, y = trie_join(rest, (a0, a1, b0, b1, alone[n]), free, budget)
            x, y = local_roots(mine[x], mine[y])
            out.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in (0, 1)], names=["a", "b"])

    tries = fps.select("fp").mapInArrow(turn, "trie int, prefix long, fp long")
    dealt = deal_pairs(tries, ["trie", "prefix"], "fp", None)
    return dealt.mapInArrow(by_groups(["trie", "prefix", "_lo", "_hi"], work, ["trie", "prefix", "fp", "_lo", "_hi", "_side"]), "a long, b long")


def _components(docs: DataFrame, budget: int = 4, words: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``docs`` without its text, with ``fp``; and ``fp, first, root, _n``: each fingerprint's smallest id, its component, and its number of rows."""
    fps = cut(fingerprints(docs, "fp", words, seed))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n")))
    linked = connected_components(links(nodes, budget))
    return fps, cut(nodes.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component"))


def _sizes(rooted: DataFrame) -> DataFrame:
    """Fingerprints of each component."""
    return rooted.groupBy("root").agg(F.count("*").alias("_n"))


def near_duplicates(docs: DataFrame, budget: int = 4, words: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs(doc_id, text)``.

    Documents whose fingerprints differ in ``budget`` bits or fewer are linked;
    ``component_id`` is the smallest id that links lead to, the own included.
    Equal fingerprints are one node, so copies cost nothing.  Null and empty
    texts and texts of white space have fingerprint 0, which is linked like any
    other.  Rows with a null id are compared too but name no component; a
    component without any id has a null one.  Repeated rows and ids are rows
    like others, other columns are left out, an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fps, rooted = _components(docs, budget, words, seed)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = spread_join(rooted.select("fp", "root"), named, ["root"], _sizes(rooted), ["fp"]).select("fp", "component_id")
    return spread_join(fps, named, ["fp"], rooted, ["doc_id"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, by id and text, columns unchanged.

    Of rows repeated with the same id and text one stays; an id with several
    texts is a document for each.  Rows with a null id have no rank among the
    others: of those of a component the first stays too.  Texts are told apart
    by two 64-bit hashes.  Empty texts are copies of each other; an empty table
    gives no rows.  Columns of any name stay.
    """
    own = F.struct(F.xxhash64(F.col("text").cast("string")).alias("a"), F.xxhash64(F.lit(1), F.col("text").cast("string")).alias("b"))
    fps, rooted = _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), own.alias("_text")), **parameters)
    # The first of each fingerprint, then of each component.
    each = fps.groupBy("fp", F.col("doc_id").isNull().alias("_null")).agg(F.min(F.struct("doc_id", "_text")).alias("k"))
    first = each.join(rooted.select("fp", "root"), "fp").groupBy("root", "_null").agg(F.min("k").alias("k"))
    first = first.select(F.col("k.doc_id").alias("_id"), F.col("k._text").alias("_own"))
    again = cut(fps.groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_own")).agg(F.count("*").alias("_n")).filter("_n > 1"))
    rest, back = set_aside(docs)
    rest = rest.withColumns({"_own": own, "_id": F.col("doc_id").cast("long")})
    if not again.head(1):
        return spread_join(rest, first, ["_id", "_own"], again).select(*back)
    # Only rows that are repeated, if there are any, are grouped once more.
    repeated = again.select(F.col("_id").alias("_i"), F.col("_own").alias("_o"), F.lit(True).alias("_again"))
    first = cut(first.join(repeated, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_own") == F.col("_o")), "left").select("_id", "_own", F.coalesce("_again", F.lit(False)).alias("_again")))
    once = spread_join(rest, first.filter("not _again"), ["_id", "_own"], again)
    several = spread_join(rest, first.filter("_again"), ["_id", "_own"], again).dropDuplicates(["_id", "_own"])
    return once.unionByName(several).select(*back)
