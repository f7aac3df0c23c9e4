"""Fuzzy line dedup: MinHash bands, exact Jaccard, one line per component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .common import cut, let, set_aside
from .components import connected_components, local_roots
from .groups import by_groups, deal_pairs, spread_join

#: Characters of a shingle.
SHINGLE = 8
#: A signature has BANDS bands of ROWS values; at Jaccard 0.8 a pair shares a band with probability 0.995.
BANDS, ROWS = 10, 4
#: Lines that one task compares with as many others at once.
PART = 1024


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of the lines, one line after the other, and each line's number of them.

    A line shorter than a shingle is one shingle.  ``size`` is a power of two.
    """
    length = np.fromiter(map(len, lines), "i8", len(lines))
    if not length.sum():
        return np.zeros(0, "u8"), np.zeros(len(lines), "i8")
    h = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8") + np.uint64(1)
    ends = np.cumsum(length)
    # Zeros behind each line make a short line's shingle its own.
    padded = np.zeros(len(h) + len(lines) * size, "u8")
    line = np.repeat(np.arange(len(lines)), length)
    padded[np.arange(len(h)) + line * size] = h
    step, base = 1, 0x9E3779B97F4A7C15
    while step < size:
        ahead = np.zeros_like(padded)
        ahead[:-step] = padded[step:]
        padded = padded * np.uint64(base) + ahead
        base = base * base % 2**64
        step *= 2
    count = np.where(length > 0, np.maximum(length - size + 1, 1), 0)
    first = ends - length + np.arange(len(lines)) * size
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return _mix(padded[at]), count


def _mix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def bands(lines: list[str], n_bands: int = BANDS, n_rows: int = ROWS, size: int = SHINGLE) -> np.ndarray:
    """Band hashes of each line: a one-permutation MinHash whose empty bins take the next full bin's value.

    Signatures use 32-bit hashes, of which a line's shingles rarely share one; candidates are verified anyway.
    """
    bins = n_bands * n_rows
    none = np.uint32(0xFFFFFFFF)
    low = np.full(len(lines) * bins, none, "u4")
    if lines:
        # Zeros between lines: as many as a shingle has characters.
        gap = "\0" * size
        h = np.frombuffer((gap.join(lines) + gap).encode("utf-32-le", "surrogatepass"), "<u4")
        step, base = 1, 0x9E3779B1
        while step < size:
            h = h[:-step] * np.uint32(base) + h[step:]
            base = base * base % 2**32
            step *= 2
        length = np.fromiter(map(len, lines), "i8", len(lines))
        wide = length + size
        count = np.where(length > 0, np.maximum(length - size + 1, 1), 0)
        line = np.repeat(np.arange(len(lines)), wide)[: len(h)]
        whole = np.arange(len(h)) < np.repeat(np.cumsum(wide) - wide + count, wide)[: len(h)]
        h = _mix32(h[whole])
        np.minimum.at(low, line[whole] * bins + (((h >> np.uint32(16)) * np.uint32(bins)) >> np.uint32(16)), h)
    low = low.reshape(len(lines), bins)
    for _ in range(2):  # the second turn goes around the end
        for k in range(bins - 1, -1, -1):
            following = low[:, (k + 1) % bins]
            low[:, k] = np.where(low[:, k] == none, following, low[:, k])
    out = np.zeros((len(lines), n_bands), "u8")
    for b in range(n_bands):
        v = np.full(len(lines), b + 1, "u8")
        for r in range(n_rows):
            v = _mix(v * np.uint64(0x9E3779B97F4A7C15) + low[:, b * n_rows + r])
        out[:, b] = v
    return out.view("i8")


def line_key(line: str) -> int:
    """As Spark's xxhash64 of the string."""
    return int(np.uint64(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)).astype(np.int64))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def text_hash(text: Column) -> Column:
    """What tells texts of one id apart; a null text has one too."""
    return F.xxhash64(text)


def content(line: Column) -> Column:
    """What lines are compared by: the line without spaces, tabs and carriage returns at its ends."""
    return F.trim(line, F.lit(" \t\r"))


def _signatures(batches):
    """Texts to rows ``band, key``: once per distinct line of a task, or nearly so."""
    done: set[int] = set()
    for batch in pieces(batches, "text", 1_000_000):
        seen: dict[int, str] = {}
        for t in batch.column("text").to_pylist():
            for line in (t or "").split("\n"):
                if line := line.strip(" \t\r"):
                    seen[line_key(line)] = line
        for key in done & seen.keys():
            del seen[key]
        if len(done) > 500_000:  # repeated rows only cost time
            done.clear()
        done |= seen.keys()
        keys, lines = np.fromiter(seen, "i8", len(seen)), list(seen.values())
        yield pa.RecordBatch.from_arrays([pa.array(bands(lines).ravel()), pa.array(np.repeat(keys, BANDS))], names=["band", "key"])


def _shared(batches):
    """Of rows sorted by ``band, key``: one for each key in each band that has several."""
    band, key, told = None, None, True

    for batch in batches:
        b, k = (batch.column(c).to_numpy() for c in ("band", "key"))
        if not len(b):
            continue
        fresh = np.append(True, (b[1:] != b[:-1]) | (k[1:] != k[:-1]))
        fresh[0] = (b[0], k[0]) != (band, key)
        b, k = b[fresh], k[fresh]
        if not len(b):
            continue
        before = np.append(b[0] == band, b[1:] == b[:-1])
        after = np.append(b[1:] == b[:-1], False)
        keep = before | after
        late = before[0] and not told  # the key held back has company now
        held = (np.append([band], b[keep]), np.append([key], k[keep])) if late else (b[keep], k[keep])
        yield pa.RecordBatch.from_arrays([pa.array(held[0].astype("i8")), pa.array(held[1].astype("i8"))], names=["band", "key"])
        band, key, told = b[-1], k[-1], bool(keep[-1])


def similar_sets(keys: np.ndarray, sets: list[np.ndarray], first: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Stars ``a, b`` of keys that connect all sets (sorted, distinct) of Jaccard ``threshold`` or more; with ``first``, only sets of one side to the other's.

    Each set taken from the queue is compared with all sets not reached yet, so
    one comparison round per component and link step is enough.
    """
    if len(sets) == 2:
        merged = np.sort(np.concatenate(sets))
        common = int((merged[1:] == merged[:-1]).sum())
        hit = common >= threshold * (len(merged) - common)
        return (keys[:1], keys[1:]) if hit else (keys[:0], keys[:0])
    every, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(every), bool)
    # Members not reached yet: their numbers, sizes, and ids one after the other.
    left, sizes = np.arange(len(sets)), np.fromiter(map(len, sets), "i8", len(sets))
    ends = np.cumsum(sizes)
    span = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
    every_id, a, b = ids, [], []
    while len(left):
        queue = [int(left[0])]
        keep = left != left[0]
        left, sizes, ids = left[keep], sizes[keep], ids[np.repeat(keep, sizes)]
        while queue and len(left):
            x = queue.pop()
            lo, hi = span[x]
            mark[every_id[lo:hi]] = True
            common = np.add.reduceat(mark[ids], np.cumsum(sizes) - sizes, dtype="i8")
            mark[every_id[lo:hi]] = False
            near = common >= threshold * (sizes + (hi - lo) - common)
            if first is not None:
                near &= first[left] != first[x]
            if near.any():
                found = left[near]
                a.append(np.repeat(keys[x], len(found)))
                b.append(keys[found])
                queue += found.tolist()
                left, ids, sizes = left[~near], ids[np.repeat(~near, sizes)], sizes[~near]
    return tuple(np.concatenate(x) if x else keys[:0] for x in (a, b))


def _verify(threshold: float):
    def work(rows, starts):
        lines, where = np.unique(rows["line"].astype(object), return_inverse=True)
        sets: list[np.ndarray] = []
        room = np.cumsum(np.fromiter(map(len, lines), "i8", len(lines))) // 500_000  # characters hashed at once
        for part in np.split(lines, np.flatnonzero(np.diff(room)) + 1):
            h, count = shingle_hashes(part.tolist())
            ends = np.cumsum(count).tolist()
            sets += [np.unique(h[lo:hi]) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
        a, b = [], []
        alone = (rows["_lo"] == rows["_hi"])[starts[:-1]].tolist()
        for lo, hi, one in zip(starts[:-1].tolist(), starts[1:].tolist(), alone, strict=True):
            x, y = similar_sets(rows["key"][lo:hi], [sets[k] for k in where[lo:hi]], None if one else rows["_side"][lo:hi], threshold)
            if len(x):
                a.append(x)
                b.append(y)
        x, y = local_roots(*(np.concatenate(x) if x else np.zeros(0, "i8") for x in (a, b)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return by_groups(["band", "_lo", "_hi"], work, ["band", "key", "line", "_lo", "_hi", "_side"], 4_000_000, 8_000)


def different_sets(shared: DataFrame) -> DataFrame:
    """Of the bands that hold the same keys, one: near copies meet in most bands, and one of them verifies them all."""
    both = [F.bit_xor(F.xxhash64(F.lit(k), "key")).alias(f"x{k}") for k in (1, 2)]
    sets = shared.groupBy("band").agg(F.count("*").alias("n"), *both)
    one = sets.groupBy("n", "x1", "x2").agg(F.min("band").alias("band")).select("band")
    return shared.join(one, "band", "left_semi")


def duplicate_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, n_lines, removed, text_hash, n_rows`` of every document in ``docs(doc_id, text)``: its lines, the numbers (from 0) of those to remove, and the rows that hold it.

    A document is an id and a text, known by its 64-bit hash: rows that share an id (or have none) but not the text are documents of their own.

    Two lines are linked if the sets of their 8-character shingles have a
    Jaccard similarity of ``threshold`` or more, verified exactly on hashed
    shingles (64 bits); a shorter line is one shingle.  Of each component of
    linked lines the first stays, by ``doc_id``, hash of the text and line number.  Lines are
    compared without spaces, tabs and carriage returns at their ends and known
    by a 64-bit hash; blank lines are neither compared nor removed.

    Null and empty texts have one blank line.  Rows that repeat an id and its
    text count as one document, whose lines are kept or removed together.  Null
    ids come before all others.  Other columns are left out; an empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Hashed before the lines are made: no line carries its document's text.
    docs = docs.withColumn("text_hash", text_hash(F.col("text")))
    line = docs.select("doc_id", "text_hash", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    lines = cut(line.select("doc_id", "text_hash", "line_no", F.when(content(F.col("line")) != "", F.xxhash64(content(F.col("line")))).alias("key")))

    banded = docs.select("text").mapInArrow(_signatures, "band long, key long")
    shared = cut(banded.repartition("band").sortWithinPartitions("band", "key").mapInArrow(_shared, "band long, key long"))
    shared = cut(different_sets(shared))
    named = line.select(content(F.col("line")).alias("line")).filter("line <> ''").select(F.xxhash64("line").alias("key"), "line")
    place = F.struct("doc_id", "text_hash", "line_no")
    each = cut(lines.filter("key is not null").groupBy("key").agg(F.count("*").alias("_n"), F.min(place).alias("first")))
    # A line that stands in very many documents is fetched by several tasks.
    texts = spread_join(named, shared.select("key").distinct(), ["key"], each, nulls=False).groupBy("key").agg(F.min("line").alias("line"))
    dealt = deal_pairs(shared, ["band"], "key", texts, PART)
    linked = connected_components(dealt.mapInArrow(_verify(threshold), "a long, b long")).withColumnRenamed("node", "key")

    # From the first place of each line that of each component; only lines that occur again or are linked can go.
    kept = linked.join(each, "key").groupBy("component").agg(F.min("first").alias("kept"), F.count("*").alias("_n"))
    linked = spread_join(linked, kept.drop("_n"), ["component"], kept, ["key"]).select("key", "kept")
    again = each.join(linked, "key", "left").filter("_n > 1 or kept is not null")
    again = cut(again.select("key", "_n", F.coalesce("kept", "first").alias("kept")))
    gone = spread_join(lines, again.drop("_n"), ["key"], again, ["doc_id", "text_hash", "line_no"]).filter(~F.col("kept").eqNullSafe(place))
    gone = gone.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    every = lines.groupBy("doc_id", "text_hash").agg((F.max("line_no") + 1).alias("n_lines"), F.count_if(F.col("line_no") == 0).alias("n_rows"))
    joined = every.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    return joined.select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), "text_hash", "n_rows")


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with the lines that ``duplicate_lines`` removes taken out of ``text``; other columns as they are.

    Documents that had lines with content and lost all of them are left out:
    all they held is elsewhere.  Null and blank texts stay as they are.  See
    ``duplicate_lines`` for null and repeated ids, repeated rows and empty tables.
    Columns of any name stay.
    """
    found = cut(duplicate_lines(docs, threshold).filter(F.size("removed") > 0))
    found = found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("removed").alias("_removed"), F.col("n_rows").alias("_n"))
    rows, back = set_aside(docs)
    rows = rows.withColumns({"_d": F.col("doc_id").cast("long"), "_h": text_hash(F.col("text").cast("string"))})
    rows = spread_join(rows, found.drop("_n"), ["_d", "_h"], found, how="left")

    def stay(split: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_removed"))
        return F.transform(kept, lambda i: F.element_at(split, i + 1))

    rows = rows.withColumn("_lines", F.when(F.col("_removed").isNotNull(), let(split_lines(F.col("text")), stay)))
    rows = rows.filter(F.col("_lines").isNull() | F.exists("_lines", lambda x: content(x) != ""))
    return rows.withColumn("text", F.when(F.col("_lines").isNull(), F.col("text")).otherwise(F.array_join("_lines", "\n"))).select(*back)
