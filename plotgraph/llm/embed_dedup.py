"""Embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces
from .common import cut, rename_clashes
from .components import connected_components, local_roots
from .groups import by_groups, deal_pairs, spread_join

#: Groups of up to this many vectors are compared many at a time.
SMALL = 48
#: Pivots that a list's key can tell apart.
WIDE = 1 << 16


def choose_pivots(vectors: DataFrame, pivots: int = 256, apart: float = 0.9) -> dict[int, np.ndarray]:
    """Up to ``pivots`` unit vectors of the data as reference points, for each width that has some.

    They come from a sample of eight times as many rows, chosen by a hash: a
    bounded, documented sample for fitting.  One closer than cosine ``apart``
    to an earlier one is left out, so a large group of near copies gets one.
    """
    rows = vectors.orderBy(F.xxhash64(F.lit(3), "rep"), "rep").limit(8 * pivots).select("vec").collect()
    chosen: dict[int, list[np.ndarray]] = {}
    for (v,) in rows:
        u = np.array(v, dtype="f8")
        u /= np.linalg.norm(u)
        mine = chosen.setdefault(len(u), [])
        if len(mine) < pivots and (not mine or (np.array(mine) @ u).max() < apart):
            mine.append(u)
    return {width: np.array(found) for width, found in chosen.items()}


def _describe(pivots: dict[int, np.ndarray], nearest: int):
    """For mapInArrow: vectors with ``near``, the numbers of their width's nearest pivots in ascending order; none for a vector whose width has no pivots."""

    def run(batches):
        for batch in pieces(batches, "vec", 2_000_000):
            vec = batch.column("vec").to_pylist()
            near: list[list[int]] = [[] for _ in vec]
            for width, points in pivots.items():
                fit = [i for i, v in enumerate(vec) if len(v) == width]
                if fit:
                    order = np.argsort(-(np.array([vec[i] for i in fit], "f8") @ points.T), axis=1, kind="stable")[:, :nearest]
                    for i, row in zip(fit, np.sort(order, axis=1).tolist(), strict=True):
                        near[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, "near"])

    return run


def _stacked(lists: np.ndarray, fill: float, kind: str) -> np.ndarray:
    """Lists as the rows of a matrix, the shorter ones filled up."""
    length = np.fromiter(map(len, lists), "i8", len(lists))
    out = np.full((len(lists), int(length.max(initial=0))), fill, kind)
    for w in np.unique(length[length > 0]):
        out[length == w, :w] = np.stack(lists[length == w].tolist())
    return out


def links(vectors: DataFrame, pivots: dict[int, np.ndarray], threshold: float = 0.98, nearest: int = 7, shared: int = 3, listed: int = 2) -> DataFrame:
    """Verified links of ``vectors(rep, label, vec, n)``: rows ``node, root, links``.

    A vector is described by its ``nearest`` pivots and stands in an inverted
    list for each set of ``listed`` of them.  In a list the pivots that two
    vectors share are counted; those with ``shared`` or more (at least
    ``listed``) are candidates, in the list of their first shared pivots only,
    so each pair is verified once.  A candidate of cosine ``threshold`` or more
    (double precision) is a link.  ``links`` adds up the ``n`` of a node's
    linked vectors; ``node - root`` edges connect all that are linked.
    """
    if not listed <= shared or listed > 3 or max(map(len, pivots.values()), default=0) > WIDE:
        raise ValueError("listed is 3 at most and not above shared; pivots are 65536 at most")
    # Fewer pivots than have to be shared tell nothing apart.
    pivots = {width: points for width, points in pivots.items() if len(points) >= shared}
    described = cut(vectors.mapInArrow(_describe(pivots, nearest), T.StructType([*vectors.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])))
    # Vectors of different widths link with nothing: each width has labels of its own.
    described = described.withColumn("label", F.concat_ws("/", F.size("vec").cast("string"), "label"))

    def number(chosen: tuple[int, ...]) -> Column:
        return functools.reduce(lambda key, i: key * WIDE + F.col("near")[i], chosen, F.lit(0).cast("long"))

    # Vectors of a width without pivots have one list.
    keys = F.array((-1 - F.size("vec")).cast("long"))
    for n in sorted({min(nearest, len(points)) for points in pivots.values()}):
        keys = F.when(F.size("near") == n, F.array(*map(number, itertools.combinations(range(n), listed)))).otherwise(keys)
    lists = cut(described.select("label", F.explode(keys).alias("key"), "rep"))
    dealt = deal_pairs(lists, ["label", "key"], "rep", described.select("rep", "vec", "n", "near"))

    def work(rows, starts):
        sizes = np.diff(starts)
        rep, n, key, side = rows["rep"], rows["n"], rows["key"], rows["_side"]
        x, near = _stacked(rows["vec"], 0, "f8"), _stacked(rows["near"], -1, "i4")
        norm = np.sqrt((x * x).sum(1))
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def first_here(a, b):
            """Pairs that share enough pivots, the first of them being this list's."""
            if not near.shape[1]:
                return key[a] < 0
            common = ((near[a][:, :, None] == near[b][:, None, :]) & (near[b] >= 0)[:, None, :]).any(2)
            upto = common.cumsum(1)
            own = np.zeros(len(a), "i8")
            for k in range(1, listed + 1):
                own = own * WIDE + near[a, (upto == k).argmax(1)]
            return (key[a] < 0) | ((upto[:, -1] >= shared) & (own == key[a]))

        def verify(a, b):
            for at in range(0, len(a), 50_000):
                i, j = a[at : at + 50_000], b[at : at + 50_000]
                keep = first_here(i, j)
                i, j = i[keep], j[keep]
                keep = (x[i] * x[j]).sum(1) / (norm[i] * norm[j]) >= threshold
                found.append((i[keep], j[keep]))

        alone = (rows["_lo"] == rows["_hi"])[starts[:-1]]
        small = alone & (sizes <= SMALL)
        for k in np.unique(sizes[small]):
            at = starts[:-1][small & (sizes == k)]
            i, j = np.triu_indices(k, 1)
            verify((at[:, None] + i).ravel(), (at[:, None] + j).ravel())
        for g in np.flatnonzero(~small):
            lo, hi = starts[g], starts[g + 1]
            middle = lo if alone[g] else lo + int(np.searchsorted(side[lo:hi], 1))
            first = slice(lo, hi) if alone[g] else slice(lo, middle)
            used, where = np.unique(near[lo:hi], return_inverse=True)
            has = np.zeros((hi - lo, len(used)), "f4")  # which pivots each vector has
            if len(used):
                has[np.arange(hi - lo)[:, None], where.reshape(hi - lo, -1)] = 1
                has[:, used < 0] = 0
            for at in range(middle, hi, 512):
                to = min(at + 512, hi)
                enough = np.ones((first.stop - first.start, to - at), bool)
                if key[lo] >= 0:
                    enough = has[first.start - lo : first.stop - lo] @ has[at - lo : to - lo].T >= shared
                # Near the threshold the exact sum decides.
                a, b = np.nonzero(enough & ((x[first] @ x[at:to].T) >= (threshold - 1e-9) * norm[first][:, None] * norm[at:to][None]))
                a, b = a + first.start, b + at
                if alone[g]:
                    a, b = a[a < b], b[a < b]
                verify(a, b)
        a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, "i8") for i in (0, 1))
        nodes, inverse = np.unique(rep[np.concatenate([a, b])], return_inverse=True)
        weight = np.bincount(inverse, np.concatenate([n[b], n[a]]), minlength=len(nodes)).astype("i8")
        child, root = local_roots(rep[a], rep[b])
        to = nodes.copy()
        to[np.searchsorted(nodes, child)] = root
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(to, pa.int64()), pa.array(weight, pa.int64())], names=["node", "root", "links"])

    columns = ["label", "key", "rep", "vec", "n", "near", "_lo", "_hi", "_side"]
    return dealt.mapInArrow(by_groups(["label", "key", "_lo", "_hi"], work, columns, 4_000_000), "node long, root long, links long")


def label_text(label: Column, kind: T.DataType) -> Column:
    """Labels as texts that are equal if and only if the labels are."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        label = label + F.lit(0.0).cast(kind)  # the two zeros are equal
    if isinstance(kind, T.BinaryType):
        return F.hex(label)
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.when(label.isNotNull(), F.to_json(F.struct(label)))
    return label.cast("string")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, pivots: int = 256, nearest: int = 7, shared: int = 3, listed: int = 2) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector of ``embeddings(vec_id, embedding, label)``.

    Two vectors are linked if their labels are equal and not null and their
    cosine in double precision is ``threshold`` or more.  Labels are compared
    in their own type.  Vectors that are
    null, empty, zero or hold null or non-finite components, and those without
    a label, link with nothing.  Equal vectors are one node and are linked.
    Single-precision components are kept as such and compared in double.
    The index is approximate: a pair is found if the two share ``shared`` of
    their ``nearest`` pivots; no unlinked pair is ever reported.  Tests measure
    its recall against brute force.  ``pivots`` should grow with the vectors:
    the lists of one label have about ``listed`` pivots of them in common.

    ``vec_id`` names a vector: of rows that repeat an id one stays (a usable
    one first, then the smallest label and components); null ids are left out.
    Vectors of different widths don't link; each width has pivots of its own,
    from the rows of the sample that have it, and vectors of a width that has
    fewer than ``shared`` of them are compared among each other in full.  Other
    columns are left out.
    """
    single = isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType)
    value = F.col("embedding").cast("array<double>")
    usable = F.coalesce(F.col("label").isNotNull() & (F.size(value) > 0) & F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(value, lambda v: v != 0), F.lit(False))
    rows = embeddings.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.struct((~usable).alias("no"), label_text(F.col("label"), embeddings.schema["label"].dataType).alias("label"), F.transform(value, lambda v: v + F.lit(0.0)).cast("array<float>" if single else "array<double>").alias("vec")).alias("v"))
    rows = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.*"))
    sound = rows.filter("not no").select("vec_id", "label", "vec")
    vectors = cut(sound.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    found = links(vectors, choose_pivots(vectors, pivots), threshold, nearest, shared, listed) if vectors.head(1) else None
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    linked = found.groupBy(F.col("node").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    named = vectors.join(linked, "rep", "left").join(component, "rep", "left")
    named = named.select("label", "vec", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # A group of equal vectors is one row there and may be a third of the rows here.
    keyed = named.select(F.xxhash64("label", "vec").alias("h"), "label", "vec", "n", "n_links", "component_id")
    out = rows.withColumn("label", F.when(~F.col("no"), F.col("label"))).withColumn("h", F.xxhash64("label", "vec"))
    out = spread_join(out, keyed.drop("n"), ["h", "label", "vec"], keyed.select("h", "label", "vec", F.col("n").alias("_n")).filter("_n > 1"), ["vec_id"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def keep_one(embeddings: DataFrame, **parameters) -> DataFrame:
    """The rows of ``embeddings`` whose vector is kept, columns unchanged; rows with a null id stay."""
    kept = near_duplicates(embeddings, **parameters).filter("kept").select(F.col("vec_id").alias("_kept"))
    rows = rename_clashes(embeddings, ["_kept"])
    return rows.join(kept, rows["vec_id"] == F.col("_kept")).select(*embeddings.columns).unionByName(embeddings.filter("vec_id is null"))
