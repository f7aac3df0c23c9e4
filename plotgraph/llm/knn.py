"""Exact top-k search by inner product: a Voronoi kNN join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Queries that one task holds.
QUERY_BLOCK = 512
LOWEST = np.iinfo("i8").min


def _padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), "i8")
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _assign(centres: np.ndarray):
    """Vectors with their nearest pivot (their cell) and the distance to it."""
    squares = (centres**2).sum(1)

    def run(batches):
        for batch in batches:
            x = _padded(batch.column("vec").to_pylist(), centres.shape[1]).astype("f8")
            cell = np.argmin(squares - 2 * (x @ centres.T), axis=1) if len(x) else np.zeros(0, "i8")
            d = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d)], names=[*batch.schema.names, "cell", "d"])

    return run


def needed_cells(centres: np.ndarray, query_radius: dict[int, float], radius: dict[int, float], nearest: dict[int, list[float]], k: int) -> list[tuple[int, int]]:
    """(query cell, data cell) for all data cells that may hold one of the k best of a query in the query cell.

    With pivots c and p, a query within s of c and a vector within d of p, the
    inner product is within |c| d + s |p| + s d of that of c and p.  The
    summaries (distances of each cell's k + 1 vectors nearest to its pivot)
    give k + 1 lower bounds, one of which may be the query itself; a cell whose
    upper bound is below the last of them is not needed.
    """
    norm = np.sqrt((centres**2).sum(1))
    out = []
    cells = sorted(radius)
    for i, s in query_radius.items():
        dot = centres @ centres[i]
        spread = lambda j, d: norm[i] * d + s * norm[j] + s * d  # noqa: E731, B023
        low = sorted((dot[j] - spread(j, d) for j in cells for d in nearest.get(j, [])), reverse=True)
        bound = low[k] if len(low) > k else -math.inf
        slack = 1e-9 * (1 + abs(bound)) if bound > -math.inf else 0.0
        out += [(i, j) for j in cells if dot[j] + spread(j, radius[j]) >= bound - slack - 1e-9 * abs(dot[j])]
    return out


def _solve(k: int):
    """Sorted rows of (block, salt), queries first: the k best of each query among the rows of its group."""

    def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < 2**52:
            return (q.astype("f8") @ x.T.astype("f8")).astype("i8")
        return q.astype(object) @ x.T.astype(object)

    def fitting(s: np.ndarray) -> np.ndarray:
        if s.dtype == object and s.size and not LOWEST <= s.min() <= s.max() < 2**63:
            raise ArithmeticError("a score doesn't fit a long")
        return s.astype("i8")

    def merge(best, found):
        """The k best of both, by query, score and id."""
        q, s, v = (np.concatenate(x) for x in zip(best, found, strict=True))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        first = np.searchsorted(q, q, "left")
        keep = np.arange(len(q)) - first < k
        return q[keep], s[keep], v[keep]

    def run(batches):
        at, ids, raw, best, floor, q = None, [], [], None, None, None

        def out():
            if best is not None and len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, "i8")[best[0]]), pa.array(best[2]), pa.array(best[1])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            group = list(zip(batch.column("block").to_pylist(), batch.column("salt").to_pylist(), batch.column("data").to_pylist(), strict=True))
            starts = [i for i in range(len(group)) if not i or group[i] != group[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(group)], strict=True):
                block, salt, data = group[lo]
                part = batch.slice(lo, hi - lo)
                if (block, salt) != at:
                    yield from out()
                    at, ids, raw, best, q = (block, salt), [], [], None, None
                if not data:
                    ids += part.column("vec_id").to_pylist()
                    raw += part.column("vec").to_pylist()
                    continue
                if not ids:
                    continue
                if best is None:
                    best = tuple(np.zeros(0, "i8") for _ in range(3))
                    floor = np.full(len(ids), LOWEST)
                vectors = part.column("vec").to_pylist()
                width = max(max(map(len, raw)), max(map(len, vectors)))
                if q is None or q.shape[1] < width:
                    q = _padded(raw, width)
                v = np.array(part.column("vec_id").to_pylist(), "i8")
                s = scores(q, _padded(vectors, q.shape[1]))
                s[np.array(ids, "i8")[:, None] == v[None]] = int(LOWEST)
                s = fitting(s)
                least = floor
                if s.shape[1] > k:
                    least = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                rows, cols = np.nonzero((s >= least[:, None]) & (s > LOWEST))
                best = merge(best, (rows, s[rows, cols], v[cols]))
                full = np.bincount(best[0], minlength=len(ids)) >= k
                worst = np.full(len(ids), np.iinfo("i8").max)
                np.minimum.at(worst, best[0], best[1])
                floor = np.where(full, worst, LOWEST)
        yield from out()

    return run


def top_k(embeddings: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, pivots: int = 64, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` vectors of highest integer inner product.

    Components are taken as floor(scale * x).  Vectors are grouped by their
    nearest of ``pivots`` pivots (vectors of the data, chosen by a hash of the
    ids); summaries of the cells bound what each can hold, and each query block
    gets only the cells it needs.  Blocks hold up to ``query_block`` queries;
    their data is dealt over salted tasks, each gives its ``k`` best, and a
    last ranking merges those.  Ties go to the smaller vec_id.

    ``is_query`` is a column over ``vec_id``.  Candidates are all vectors but
    the query's own.  Null vectors and ids, and vectors with null or non-finite
    components take no part; rows that repeat an id count once, with the
    smallest vector.  Scores are exact; a scaled component or a score that
    doesn't fit a long stops the search with an error.  A shorter vector counts
    as padded with zeros; an empty one scores 0.  Other columns are left out.
    """
    spark = embeddings.sparkSession

    def whole(v: Column) -> Column:
        x = v.cast("double") * scale
        return F.when(F.abs(x) < float(2**63), F.floor(x).cast("long")).otherwise(F.raise_error(F.lit("a scaled component doesn't fit a long")).cast("long"))

    scaled = F.transform("embedding", whole)
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("vec")).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    rows = cut(rows.withColumn("asks", F.coalesce(is_query, F.lit(False))))
    sample = rows.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(pivots).select("vec").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = rows.agg(F.max(F.size("vec"))).first()[0]
    centres = np.unique(_padded([r[0] for r in sample], width).astype("f8"), axis=0)
    cells = cut(rows.mapInArrow(_assign(centres), "vec_id long, vec array<long>, asks boolean, cell int, d double"))

    # A row per cell, and k + 1 distances of each: bounded by the number of pivots.
    summary = {r["cell"]: r for r in cells.groupBy("cell").agg(F.max("d").alias("r"), F.max(F.when(F.col("asks"), F.col("d"))).alias("s"), F.count(F.when(F.col("asks"), 1)).alias("n")).collect()}
    by_distance = Window.partitionBy("cell").orderBy("d", "vec_id")
    nearest: dict[int, list[float]] = {}
    for r in cells.select("cell", "d", "vec_id").withColumn("i", F.row_number().over(by_distance)).filter(F.col("i") <= k + 1).collect():
        nearest.setdefault(r["cell"], []).append(r["d"])
    asked = {c: r["s"] for c, r in summary.items() if r["n"]}
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    # Blocks of queries: small neighbouring cells together, large cells in parts.
    first, parts, at, room = {}, {}, 0, 0
    for c in sorted(asked):
        n = summary[c]["n"]
        if n > query_block // 2:
            first[c], parts[c] = at + bool(room), math.ceil(2 * n / query_block)
            at, room = first[c] + parts[c], 0
        else:
            if room + n > query_block:
                at, room = at + 1, 0
            first[c], parts[c], room = at, 1, room + n
    blocks = at + 1
    salts = max(1, math.ceil(partitions(spark) / blocks))
    need = sorted({(j, first[i], parts[i]) for i, j in needed_cells(centres, asked, {c: r["r"] for c, r in summary.items()}, nearest, k)})
    need = spark.createDataFrame(need, "cell int, first int, parts int")
    of = spark.createDataFrame([(c, first[c], parts[c]) for c in asked], "cell int, first int, parts int")
    span = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1))
    # At most pivots squared and pivots rows.
    data = cells.join(F.broadcast(need), "cell").select("vec_id", "vec", span.alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(True).alias("data"))
    part = F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.col("parts")).cast("int")
    queries = cells.filter("asks").join(F.broadcast(of), "cell").select("vec_id", "vec", (F.col("first") + part).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(False).alias("data"))
    dealt = queries.unionByName(data).repartition("block", "salt").sortWithinPartitions("block", "salt", "data")
    found = dealt.mapInArrow(_solve(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
