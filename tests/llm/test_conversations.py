import hashlib
import itertools
import random
import zlib

from plotgraph.llm import conversations

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [] if fault == 0 else [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def fits(initials):
    body = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (body != "" and len(body) % 2 == 0 and body == "ua" * (len(body) // 2))


def brute(rows):
    """All edits of a short conversation, one after the other."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(BLANK)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None

    def go(i, cost, audit, kept, ins):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows):
            if fits("".join(r[:1] or "?" for r, _ in kept)):
                best = min(best or (cost, audit, kept), (cost, audit, kept))
        else:
            _, _, role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", kept, 0)
            if faults[i] not in ("b", "d"):
                more = 5 if faults[i] == "t" else 0
                go(i + 1, cost + more, audit + "K", kept + [(role, text)], 0)
                for to in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, audit + "R", kept + [(to, text)], 0)
        if ins < 2:
            for to in ("user", "assistant"):
                go(i, cost + 5, audit + "I", kept + [(to, "")], ins + 1)

    go(0, 0, "", [], 0)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        best[0], best[1], hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest(),
    )


def summed(spark, rows, damage=True):
    df = spark.createDataFrame(rows, SCHEMA)
    found = conversations.summary(df, conversations.repair(conversations.damage(df) if damage else df))
    return {r["conv_id"]: tuple(r)[1:] for r in found.collect()}


def test_against_every_edit(spark):
    rng = random.Random(4)
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool", None, "", "Assistant"]), rng.choice(["Yes.", "No!", "cut of", None, "", " \n", "Yes.", "é?\t"])))
    rows += [(100, t, r, x) for t, r, x in ((0, "user", "a."), (0, "user", "a."), (1, "assistant", "b."))]
    got = summed(spark, rows)
    want = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = [r for r in want if r[0] == conv]
        expected = brute(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert got[conv] == expected, (conv, mine)
    assert len(got) == len({r[0] for r in rows})


def test_blocks_of_a_long_conversation_join(spark, monkeypatch):
    """The same conversations in blocks of 3 and of 256 rows, one of them with nearly all rows."""
    rng = random.Random(5)
    rows = [(7, rng.choice([None, *range(900)]), rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "cut", f"{rng.random()}.", f"{rng.random()}!", None])) for _ in range(1200)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in (1, 2) for t in range(4)]
    dealt = summed(spark, rows, damage=False)
    kept = summed(spark, [r for r in rows if r[0] != 7], damage=False)
    assert {c: dealt[c] for c in kept} == kept
    monkeypatch.setattr(conversations, "BLOCK", 10**6)
    whole = summed(spark, rows, damage=False)
    assert whole == dealt
    assert whole[7][5] > 0 and len(whole[7][6]) >= 1200


def test_turns_that_are_left(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "What?"), (1, 2, "tool", "x" * 100_000 + ".")], SCHEMA)
    rows = conversations.repair(df).collect()
    assert [(t["edit"], t["role"], len(t["text"])) for t in rows[0]["turns"]] == [("K", "user", 5), ("R", "assistant", 100_001)]
    assert rows[0]["audit"] == "DKR" and rows[0]["cost"] == 3


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.summary(empty, conversations.repair(conversations.damage(empty))).count() == 0
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b.")], SCHEMA).withColumns({"_key": F.lit(1), "block": F.lit(2), "cost": F.lit(3), "_fault": F.lit(4)})
    assert conversations.summary(df, conversations.repair(df)).first()["audit"] == "KK"
