"""Repairing the turn structure of conversations at least cost.

A conversation's role initials have to be ``(s?(ua)+)?``.  Four grammar states
are enough: nothing yet, after the system turn, after a user turn, after an
assistant turn.  Conversations are hash-partitioned; inside a batch a recursive
DuckDB query advances one turn of all conversations at once and keeps the least
``(cost, audit)`` of every state.

A conversation is walked in blocks of turns.  A block is solved from every state
that it may be entered in, so the blocks of one conversation don't wait for each
other and a second recursion joins them.  Conversations with more rows than a
task's even share are dealt block by block over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import numbered
from .common import cut
from .groups import heavy_keys

#: Turns that one recursion walks.
BLOCK = 256
#: Rows, and bytes of text, that are gathered before a query runs.
BATCH_ROWS, BATCH_BYTES = 20_000, 8_000_000
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Costs of edits, and of keeping a row that breaks off.
KEEP, REROLE, DELETE, INSERT, BROKEN = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FOLLOWS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)}

TURN = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
COUNTS = ["blank", "duplicate", "truncated", "illegal", "n_turns"]
BLOCKS = "_key string, block long, cost long, audit string, turns array<struct<edit:string,role:string,text:string>>, blank long, duplicate long, truncated long, illegal long, n_turns long, low long, high long, first string, last string"


def inserts(state: int) -> list[tuple[int, str]]:
    """States that inserted turns lead to, with their letters; a state is never worth coming back to."""
    out, seen = [(state, "")], {state}
    for at, letters in out:
        for to in (USER, ASSISTANT):
            if (at, to) in FOLLOWS and to not in seen:
                seen.add(to)
                out.append((to, letters + "I"))
    return out


def moves() -> pa.Table:
    """``kind, src, dst, letters, cost, stays``: what can become of a row of some kind (its initial's state, 0 for other initials, -1 if it must go), with what is inserted before it."""
    rows = []
    for src in range(4):
        for at, before in inserts(src):
            cost = INSERT * len(before)
            for kind in range(-1, 4):
                rows.append((kind, src, at, before + "D", cost + DELETE, 0))
                if kind >= 0:
                    rows += [(kind, src, to, before + "R", cost + REROLE, 1) for to in (USER, ASSISTANT) if (at, to) in FOLLOWS]
                    if (at, kind) in FOLLOWS:
                        rows.append((kind, src, kind, before + "K", cost + KEEP, 1))
    return pa.table(list(map(pa.array, zip(*rows))), names=["kind", "src", "dst", "letters", "cost", "stays"])


def ends() -> pa.Table:
    """``src, tail, more``: what has to be inserted behind the last row."""
    rows = [(s, tail, INSERT * len(tail)) for s in range(4) for to, tail in inserts(s) if to == ASSISTANT or (s, to) == (START, START)]
    return pa.table(list(map(pa.array, zip(*rows))), names=["src", "tail", "more"])


#: One recursion advances one turn of every block ``g``; ``turns(g, i, kind, broken)``, ``starts(g, entry, n)``.
ADVANCE = f"""
    WITH RECURSIVE walk AS (
        SELECT g, entry, 0::BIGINT AS i, entry AS state, 0::BIGINT AS cost, '' AS audit FROM starts
        UNION ALL
        SELECT g, entry, i, state, best.cost, best.audit FROM (
            SELECT w.g, w.entry, w.i + 1 AS i, m.dst AS state, min({{'cost': w.cost + m.cost + {BROKEN} * m.stays * t.broken, 'audit': w.audit || m.letters}}) AS best
            FROM walk w JOIN turns t ON t.g = w.g AND t.i = w.i JOIN moves m ON m.src = w.state AND m.kind = t.kind
            GROUP BY w.g, w.entry, w.i, m.dst))
    SELECT w.g, w.entry, w.state, w.cost, w.audit FROM walk w JOIN starts s ON s.g = w.g AND s.entry = w.entry AND s.n = w.i
"""

#: One recursion advances one block of every conversation ``c``; ``solved(c, b, entry, state, cost, audit)``, ``sizes(c, n)``.
CHAIN = """
    WITH RECURSIVE walk AS (
        SELECT c, 0::BIGINT AS b, 0::BIGINT AS state, 0::BIGINT AS cost, '' AS audit, [0::BIGINT] AS path FROM sizes
        UNION ALL
        SELECT c, b, state, best.cost, best.audit, best.path FROM (
            SELECT w.c, w.b + 1 AS b, s.state, min({'cost': w.cost + s.cost, 'audit': w.audit || s.audit, 'path': list_append(w.path, s.state::BIGINT)}) AS best
            FROM walk w JOIN solved s ON s.c = w.c AND s.b = w.b AND s.entry = w.state
            GROUP BY w.c, w.b, s.state)),
    done AS (
        SELECT w.c, min({'cost': w.cost + e.more, 'audit': w.audit || e.tail, 'path': w.path, 'tail': e.tail}) AS best
        FROM walk w JOIN sizes z ON z.c = w.c AND z.n = w.b JOIN ends e ON e.src = w.state GROUP BY w.c),
    steps AS (SELECT d.c, z.n, d.best.path AS path, d.best.tail AS tail, unnest(range(z.n)) AS b FROM done d JOIN sizes z ON z.c = d.c)
    SELECT s.c, s.b, s.path[s.b + 1] AS entry, o.audit || CASE WHEN s.b = s.n - 1 THEN s.tail ELSE '' END AS audit, o.cost + CASE WHEN s.b = s.n - 1 THEN 5 * length(s.tail) ELSE 0 END AS cost
    FROM steps s JOIN solved o ON o.c = s.c AND o.b = s.b AND o.entry = s.path[s.b + 1] AND o.state = s.path[s.b + 2]
    ORDER BY 1, 2
"""


def _database():
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    con.register("moves", moves())
    con.register("ends", ends())
    return con


def _query(con, text: str, **tables: pa.Table) -> dict[str, list]:
    for name, rows in tables.items():
        con.register(name, rows)
    cursor = con.execute(text)
    names, rows = [d[0] for d in cursor.description], cursor.fetchall()
    for name in tables:
        con.unregister(name)
    return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


def _advance(con, g: np.ndarray, i: np.ndarray, kind: np.ndarray, broken: np.ndarray, first: np.ndarray) -> dict[str, list]:
    """Least ``(cost, audit)`` of every block ``g`` from state ``entry`` to ``state``; blocks in ``first`` are entered in START only."""
    sizes = np.bincount(g)
    starts = [(b, e, n) for b, n in enumerate(sizes.tolist()) for e in ([START] if first[b] else range(4))]
    return _query(con, ADVANCE, turns=pa.table({"g": g, "i": i, "kind": kind, "broken": broken}), starts=pa.table(list(map(pa.array, zip(*starts))), names=["g", "entry", "n"]))


def rebuild(state: int, audit: str, roles: list[str], texts: list[str]) -> list[dict[str, str]]:
    """The turns that an audit leaves of a block's rows, entered in ``state``."""
    out, at = [], 0
    for edit in audit:
        if edit != "D":
            state, kept = (ASSISTANT if state == USER else USER), edit == "K"
            if kept:
                state = INITIALS[roles[at][0]]
            role = roles[at] if kept else ("user" if state == USER else "assistant")
            out.append({"edit": edit, "role": role, "text": "" if edit == "I" else texts[at]})
        at += edit != "I"
    return out


def _block_row(key: str, block: int, cost: int, entry: int, audit: str, rows: dict[str, list]) -> dict:
    """A row of BLOCKS from a block's rows in order."""
    initials = [r[:1] for r in rows["role"]]
    turns = [t for t in rows["turn"] if t is not None]
    return {
        "_key": key, "block": block, "cost": cost, "audit": audit, "turns": rebuild(entry, audit, rows["role"], rows["text"]),
        "blank": sum(rows["blank"]), "duplicate": sum(d and not b for b, d in zip(rows["blank"], rows["duplicate"])), "truncated": sum(t and not b and not d for b, d, t in zip(rows["blank"], rows["duplicate"], rows["broken"])),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "n_turns": len(set(turns)),
        "low": min(turns, default=None), "high": max(turns, default=None), "first": initials[0], "last": initials[-1],
    }


_BLOCK_SCHEMA = pa.schema([("_key", pa.string()), ("block", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("turns", pa.list_(TURN)), *[(c, pa.int64()) for c in (*COUNTS, "low", "high")], ("first", pa.string()), ("last", pa.string())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _BLOCK_SCHEMA)


def _gathered(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of the sorted ``keys``, of about BATCH_ROWS rows or BATCH_BYTES bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < BATCH_ROWS and sum(b.nbytes for b in held) < BATCH_BYTES:
            continue
        # The last group may go on: cut where it begins.
        last = [batch.column(k)[-1].as_py() for k in keys]
        same = np.ones(batch.num_rows, bool)
        for k, v in zip(keys, last):
            same &= np.asarray(pa.compute.equal(batch.column(k), v))
        begin = int(np.argmax(same))
        if begin == 0 and len(held) > 1 and [held[-2].column(k)[-1].as_py() for k in keys] == last:
            continue
        done = [*held[:-1], batch.slice(0, begin)]
        held = [batch.slice(begin)]
        if sum(b.num_rows for b in done):
            yield pa.Table.from_batches(done).combine_chunks()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _runs(*columns: list) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted columns: each row's group, and where the groups begin (and the end)."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        a = np.asarray(c, dtype=object)
        change[1:] |= a[1:] != a[:-1]
    return np.cumsum(change) - 1, np.append(np.flatnonzero(change), n)


def _kinds(rows: dict[str, list]) -> np.ndarray:
    return np.array([-1 if b or d else INITIALS.get(r[:1], 0) for r, b, d in zip(rows["role"], rows["blank"], rows["duplicate"])], "i8")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole conversations, sorted by conversation and order."""
    con = _database()
    for table in _gathered(batches, ["_key"]):
        rows = table.to_pydict()
        c, starts = _runs(rows["_key"])
        place = np.arange(len(c)) - starts[c]
        texts = pa.table({"c": c, "place": place, "role": table.column("role"), "text": table.column("text")})
        again = _query(con, "SELECT row_number() OVER (PARTITION BY c, role, text ORDER BY place) > 1 AS again FROM texts ORDER BY c, place", texts=texts)["again"]
        rows["duplicate"] = again
        b = place // BLOCK
        g, at = _runs(c, b)
        heads = at[:-1]
        solved = _advance(con, g, np.arange(len(g)) - at[g], _kinds(rows), np.array(rows["broken"], "i8"), b[heads] == 0)
        sg = np.array(solved["g"], "i8")
        table_of = pa.table({"c": c[heads][sg], "b": b[heads][sg], "entry": solved["entry"], "state": solved["state"], "cost": solved["cost"], "audit": solved["audit"]})
        sizes = pa.table({"c": np.arange(len(starts) - 1), "n": b[starts[1:] - 1] + 1})
        chosen = _query(con, CHAIN, solved=table_of, sizes=sizes)
        out = []
        for k, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
            piece = {name: v[lo:hi] for name, v in rows.items()}
            out.append(_block_row(rows["_key"][lo], chosen["b"][k], chosen["cost"][k], chosen["entry"][k], chosen["audit"][k], piece))
        yield _batch(out)


def _solve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_key, block, entry, state, cost, audit`` of blocks, sorted by block and place."""
    con = _database()
    for table in _gathered(batches, ["_key", "block"]):
        rows = table.to_pydict()
        g, at = _runs(rows["_key"], rows["block"])
        heads = at[:-1]
        solved = _advance(con, g, np.arange(len(g)) - at[g], _kinds(rows), np.array(rows["broken"], "i8"), np.array(rows["block"], "i8")[heads] == 0)
        head = heads[np.array(solved["g"], "i8")].tolist()
        yield pa.RecordBatch.from_pydict({"_key": [rows["_key"][h] for h in head], "block": [rows["block"][h] for h in head], "entry": solved["entry"], "state": solved["state"], "cost": solved["cost"], "audit": solved["audit"]}, pa.schema([("_key", pa.string()), ("block", pa.int64()), ("entry", pa.int64()), ("state", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))


def _chain_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_key, block, entry, audit, cost``: how each block is walked, from what ``_solve_blocks`` found, sorted by conversation."""
    con = _database()
    for table in _gathered(batches, ["_key"]):
        rows = table.to_pydict()
        c, starts = _runs(rows["_key"])
        solved = pa.table({"c": c, "b": table.column("block"), **{n: table.column(n) for n in ("entry", "state", "cost", "audit")}})
        sizes = pa.table({"c": np.arange(len(starts) - 1), "n": np.maximum.reduceat(np.array(rows["block"], "i8"), starts[:-1]) + 1})
        chosen = _query(con, CHAIN, solved=solved, sizes=sizes)
        keys = [rows["_key"][starts[x]] for x in chosen["c"]]
        yield pa.RecordBatch.from_pydict({"_key": keys, "block": chosen["b"], "entry": chosen["entry"], "audit": chosen["audit"], "cost": chosen["cost"]}, pa.schema([("_key", pa.string()), ("block", pa.int64()), ("entry", pa.int64()), ("audit", pa.string()), ("cost", pa.int64())]))


def _rebuild_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCKS from rows that carry their block's ``entry, audit, cost``."""
    for table in _gathered(batches, ["_key", "block"]):
        rows = table.to_pydict()
        _, at = _runs(rows["_key"], rows["block"])
        yield _batch([_block_row(rows["_key"][lo], rows["block"][lo], rows["cost"][lo], rows["entry"][lo], rows["audit"][lo], {n: v[lo:hi] for n, v in rows.items()}) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())])


def key_of(conv_id: Column) -> Column:
    """A text for every id, of null too."""
    return F.when(conv_id.isNull(), "").otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by a hash of ``conv_id:turn``: rows dropped, emptied, without sentence ends, twice, or given to the user.

    Null roles and texts are one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("_fault", fault).filter("_fault <> 0")
    rows = rows.withColumn("_copy", F.explode(copies))
    return rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"))


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations of ``rows(conv_id, turn, role, text)`` in blocks of BLOCK rows: ``BLOCKS`` with the audit and the ``turns`` that it leaves.

    Rows are taken by turn (nulls first), then role and text, so ties are in a
    fixed order and equal rows are duplicates.  A row is ``blank`` (only
    blanks), else ``duplicate`` (its role and text came before), else
    ``truncated`` (doesn't end in ``.!?``).  Blank and duplicate rows have to be
    deleted; of the audits of least cost the ASCII-least is taken.

    A role without an initial fits nowhere, like one of another initial.  Null
    ids are one conversation (``_key`` is empty), null roles and texts one
    space.  Texts are whole however long.  No rows give none; other columns are
    left out.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(key_of(F.col("conv_id")).alias("_key"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumns({"blank": bare == "", "broken": ~F.substring(bare, -1, 1).isin(".", "!", "?")})
    counts = rows.groupBy("_key").agg(F.count("*").alias("_n"))
    heavy = cut(heavy_keys(counts, ["_key"]).join(counts.filter(F.col("_n") > BLOCK), "_key").select("_key"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    if heavy.isEmpty():
        return rows.repartition("_key").sortWithinPartitions("_key", *order).mapInArrow(_whole, BLOCKS)
    # At most as many as there are shuffle partitions.
    light = rows.join(F.broadcast(heavy), "_key", "left_anti").repartition("_key").sortWithinPartitions("_key", *order)
    long = rows.join(F.broadcast(heavy), "_key").withColumn("_row", F.monotonically_increasing_id())
    placed = cut(numbered(long, "_key", [*order, F.col("_row")], "place").withColumn("block", F.floor(F.col("place") / BLOCK)))
    first = placed.groupBy("_key", "role", "text").agg(F.min("place").alias("place")).select("_key", "place", F.lit(False).alias("again"))
    marked = placed.join(first, ["_key", "place"], "left").withColumn("duplicate", F.coalesce("again", F.lit(True))).drop("again", "_row")
    marked = cut(marked)
    by_block = lambda df: df.repartition("_key", "block").sortWithinPartitions("_key", "block", "place")
    solved = by_block(marked.select("_key", "block", "place", F.substring("role", 1, 1).alias("role"), "blank", "broken", "duplicate")).mapInArrow(_solve_blocks, "_key string, block long, entry long, state long, cost long, audit string")
    walked = cut(solved.repartition("_key").sortWithinPartitions("_key").mapInArrow(_chain_blocks, "_key string, block long, entry long, audit string, cost long"))
    pieces = by_block(marked.join(walked, ["_key", "block"])).mapInArrow(_rebuild_blocks, BLOCKS)
    return light.mapInArrow(_whole, BLOCKS).unionByName(pieces.repartition("_key").sortWithinPartitions("_key", "block"))


SUMMARY = "_key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of sorted blocks; the digest takes the turns in one after the other."""
    now: dict | None = None

    def closed(x: dict) -> dict:
        span = 0 if x["low"] is None else x["high"] - x["low"] + 1 - x["n_turns"]
        return {"_key": x["_key"], "gaps": span, **{c: x[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")}, "audit": "".join(x["audits"]), "repaired_sha256": x["digest"].hexdigest()}

    schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in SUMMARY.split(", ")])
    for batch in batches:
        out = []
        for at in range(batch.num_rows):
            x = {n: batch.column(n)[at].as_py() for n in batch.schema.names}
            if now is not None and now["_key"] != x["_key"]:
                out.append(closed(now))
                now = None
            if now is None:
                now = x | {"audits": [], "digest": hashlib.sha256(), "empty": True}
            else:
                for c in ("blank", "duplicate", "truncated", "illegal", "n_turns", "cost"):
                    now[c] += x[c]
                now["illegal"] += now["last"] + x["first"] not in ("su", "ua", "au")
                now["n_turns"] -= x["low"] is not None and now["high"] == x["low"]
                now |= {"low": x["low"] if now["low"] is None else now["low"], "high": x["high"] if x["high"] is not None else now["high"], "last": x["last"]}
            now["audits"].append(x["audit"])
            for t in x["turns"]:
                now["digest"].update((("" if now["empty"] else "\n") + t["role"] + ":" + t["text"]).encode())
                now["empty"] = False
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([closed(now)], schema)


def summary(conversations: DataFrame, blocks: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every id in ``conversations``, from ``repair``'s blocks as they are dealt.

    An id without blocks has zeros, an empty audit and the digest of an empty text.
    """
    ids = conversations.select("conv_id").distinct().withColumn("_id", key_of(F.col("conv_id")))
    found = blocks.mapInArrow(_summed, SUMMARY)
    zero = F.lit(0).cast("long")
    return ids.join(found, F.col("_id") == F.col("_key"), "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
