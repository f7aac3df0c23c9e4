"""Secrets by patterns, and by the likelihood of formats that are inferred from labelled credentials.

For every labelled format a prefix tree of its credentials is folded into a
probabilistic automaton: states whose next symbols and ends are statistically
alike are merged, those at the same depth first, then whole stretches.  So
lengths and fixed marks survive where all credentials share them, and loops
arise where they vary.  A candidate's score is its log-likelihood under the
best format less that under the automaton of ordinary tokens.
"""

from __future__ import annotations

import functools
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .common import set_aside

#: Patterns of the base kinds, in the order in which they are listed, and the least length of each.
ASSIGN = re.compile(r"""(?=[psta])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run has 16 characters at its start or nowhere, so the least length can be in these two patterns; the look-ahead above changes no match.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")
LEAST = 12  # characters that are assigned

#: A candidate is a run of a credential's characters, with up to two signs of padding behind.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{16,}={0,2}")
REMEMBERED = 512  # characters of a run whose score is kept for its repeats
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_.-=")
#: Of the candidates in ordinary text one in a hundred thousand is taken to be a secret that no pattern finds.
ODDS = math.log(1e5)
END = ""
_CLASS = {c: i for i, group in enumerate(CLASSES) for c in group}

#: Public formats, as parts of literal text and (alphabet, least, most) lengths.
LOWER, UPPER, DIGITS = CLASSES[:3]
ALNUM, HEXES, URLSAFE = LOWER + UPPER + DIGITS, DIGITS + "abcdef", LOWER + UPPER + DIGITS + "_-"
FORMATS: dict[str, list] = {
    "aws_access": ["AKIA", (UPPER + "234567", 16, 16)],
    "aws_session": ["ASIA", (UPPER + "234567", 16, 16)],
    "github": ["gh", ("pousr", 1, 1), "_", (ALNUM, 36, 36)],
    "github_fine": ["github_pat_", (ALNUM, 22, 22), "_", (ALNUM, 59, 59)],
    "gitlab": ["glpat-", (URLSAFE, 20, 20)],
    "slack": ["xox", ("abp", 1, 1), "-", (DIGITS, 10, 13), "-", (DIGITS, 10, 13), "-", (ALNUM, 24, 24)],
    "stripe": ["sk_live_", (ALNUM, 24, 24)],
    "stripe_restricted": ["rk_live_", (ALNUM, 24, 24)],
    "google": ["AIza", (URLSAFE, 35, 35)],
    "google_oauth": ["ya29.", (URLSAFE, 60, 90)],
    "npm": ["npm_", (ALNUM, 36, 36)],
    "pypi": ["pypi-AgEIcHlwaS5vcmc", (URLSAFE, 70, 110)],
    "sendgrid": ["SG.", (URLSAFE, 22, 22), ".", (URLSAFE, 43, 43)],
    "twilio": ["SK", (HEXES, 32, 32)],
    "jwt": ["eyJ", (URLSAFE, 17, 60), ".eyJ", (URLSAFE, 30, 120), ".", (URLSAFE, 43, 43)],
    "uuid": [(HEXES, 8, 8), "-", (HEXES, 4, 4), "-4", (HEXES, 3, 3), "-", ("89ab", 1, 1), (HEXES, 3, 3), "-", (HEXES, 12, 12)],
    "base64_32": [(ALNUM + "+/", 43, 43), "="],
    "base64_64": [(ALNUM + "+/", 86, 86), "=="],
    "base64_40": [(ALNUM + "+/", 40, 40)],
}
#: Words that ordinary tokens are made of.
WORDS = (
    "account address amount apply array batch begin block branch buffer build cache channel check client cluster column command commit config content context control copy count create current "
    "data date decode default delete device display document driver element encode entry error event example execute export factory feature field file filter final format frame function general "
    "gradle group handler header image import index input instance integer internal item java json kernel label layer length level library license linear list local main manager map master member "
    "memory message method metric model module monitor native network node number object offset option order output package page parser password path plugin point pool process project property "
    "public query queue random range record region register release remote report request reset resource response result return sample scale schema script search section select server service "
    "session shared simple size source spark stage start state static status storage stream string struct summary support system table target task template test text thread time timeout token "
    "total transform tree type union unit update user util value vector version view widget window worker write"
).split()


@dataclass
class State:
    """A state of an automaton: how many strings came by, which ended here, and where symbols lead."""

    depth: int
    n: int = 0
    ended: int = 0
    count: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


def prefix_tree(strings: list[str]) -> list[State]:
    """The tree of the strings' beginnings, its states in order of their depth."""
    states = [State(0)]
    now = {i: 0 for i in range(len(strings))}
    for depth in range(max(map(len, strings), default=0) + 1):
        after = {}
        for i, s in now.items():
            state = states[s]
            state.n += 1
            if len(strings[i]) == depth:
                state.ended += 1
                continue
            c = strings[i][depth]
            state.count[c] = state.count.get(c, 0) + 1
            if c not in state.to:
                state.to[c] = len(states)
                states.append(State(depth + 1))
            after[i] = state.to[c]
        now = after
    return states


def slack(n: int, m: int, alpha: float) -> float:
    """How far two frequencies of one probability, seen in n and in m cases, may lie apart: Hoeffding's bound."""
    return math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))


class Folding:
    """An automaton whose states are merged step by step."""

    def __init__(self, states: list[State], alpha: float):
        self.states, self.alpha = states, alpha
        self.into = list(range(len(states)))
        self.apart: set[tuple[int, int]] = set()  # since the last merge

    def find(self, s: int) -> int:
        while self.into[s] != s:
            self.into[s] = self.into[self.into[s]]
            s = self.into[s]
        return s

    def compatible(self, a: int, b: int, seen: set | None = None) -> bool:
        """Whether two states, and the states that equal symbols lead to, have alike ends and next symbols."""
        seen = set() if seen is None else seen
        a, b = self.find(a), self.find(b)
        if a == b or (a, b) in seen:
            return True
        if (a, b) in self.apart:
            return False
        seen.add((a, b))
        x, y = self.states[a], self.states[b]
        most = slack(x.n, y.n, self.alpha)
        if most >= 1:  # too few cases to tell, and fewer below
            return True
        group, below = [0.0] * len(CLASSES), {}
        for c in x.count.keys() | y.count.keys():
            gap = x.count.get(c, 0) / x.n - y.count.get(c, 0) / y.n
            group[_CLASS[c]] += gap
            if abs(gap) > most:
                break
            if c in x.to and c in y.to:
                below[x.to[c], y.to[c]] = None
        else:
            # Single symbols of a large alphabet are rare, their classes aren't.
            if abs(x.ended / x.n - y.ended / y.n) <= most and max(map(abs, group)) <= most and all(self.compatible(*pair, seen) for pair in below):
                return True
        self.apart.add((a, b))
        return False

    def merge(self, a: int, b: int) -> None:
        """``b`` becomes ``a``; so do the states that equal symbols lead to."""
        todo = [(a, b)]
        self.apart.clear()
        while todo:
            a, b = (self.find(x) for x in todo.pop())
            if a == b:
                continue
            if self.states[b].depth < self.states[a].depth:
                a, b = b, a
            x, y = self.states[a], self.states[b]
            self.into[b] = a
            x.n, x.ended = x.n + y.n, x.ended + y.ended
            for c, k in y.count.items():
                x.count[c] = x.count.get(c, 0) + k
                if c in x.to:
                    todo.append((x.to[c], y.to[c]))
                else:
                    x.to[c] = y.to[c]

    def after(self, states: list[int]) -> list[int]:
        """The states that ``states`` lead to, each once, in order."""
        return list(dict.fromkeys(self.find(t) for s in states for _, t in sorted(self.states[s].to.items())))

    def living(self) -> list[int]:
        """States that the first one leads to, by depth."""
        seen = {self.find(0): None}
        todo = list(seen)
        while todo:
            todo = [t for t in self.after(todo) if t not in seen]
            seen.update(dict.fromkeys(todo))
        return sorted(seen, key=lambda s: (self.states[s].depth, s))


@dataclass
class Automaton:
    """States with log-probabilities of symbols; the end of a string is the symbol END."""

    steps: list[dict[str, tuple[float, int]]]
    other: list[float]

    def score(self, text: str, floor: float = -math.inf) -> float:
        """The text's log-likelihood, or what it has come to once it is under ``floor``; a symbol that its state has never seen costs ``other`` and leads nowhere else."""
        total, at = 0.0, 0
        for c in text:
            if total < floor:
                return total
            step = self.steps[at].get(c)
            if step is None:
                total += self.other[at]
            else:
                total, at = total + step[0], step[1]
        end = self.steps[at].get(END)
        return total + (end[0] if end else self.other[at])


def infer(strings: list[str], alpha: float = 0.05, unseen: float = 1e-3) -> Automaton:
    """The automaton of labelled strings: their prefix tree, with states of one depth merged where they are compatible, then states of different depths.

    Half of a state's mass for a class of symbols is spread over the whole
    class, so that letters that happen not to be among the labelled ones are
    expected where their neighbours are.
    """
    fold = Folding(prefix_tree(strings), alpha)
    layer = [fold.find(0)]
    while layer := fold.after(layer):
        kept: list[int] = []
        for s in layer:
            if fold.find(s) != s:
                continue
            home = next((k for k in kept if fold.compatible(k, s)), None)
            if home is None:
                kept.append(s)
            else:
                fold.merge(home, s)
        layer = kept
    kept = [fold.find(0)]
    for s in fold.living()[1:]:
        if fold.find(s) != s:
            continue
        home = next((k for k in dict.fromkeys(map(fold.find, kept)) if k != s and fold.compatible(k, s)), None)
        if home is None:
            kept.append(s)
        else:
            fold.merge(home, s)
    living = fold.living()
    number = {s: i for i, s in enumerate(living)}
    steps, other = [], []
    for s in living:
        x = fold.states[s]
        p = {c: k / x.n for c, k in x.count.items()}
        for group in CLASSES[:3]:
            seen = [c for c in group if c in p]
            # One symbol alone is a fixed mark; several are an alphabet.
            if len(seen) > 2:
                width = [c for c in group if seen[0] <= c <= seen[-1]]
                mass = sum(p[c] for c in seen)
                most = max(seen, key=lambda c: (x.count[c], c))
                for c in width:
                    p[c] = 0.5 * p.get(c, 0.0) + 0.5 * mass / len(width)
                    x.to.setdefault(c, x.to[most])
        step = {c: (math.log(v * (1 - unseen)), number[fold.find(x.to[c])]) for c, v in p.items()}
        if x.ended:
            step[END] = (math.log(x.ended / x.n * (1 - unseen)), -1)
        steps.append(step)
        other.append(math.log(unseen / 65))
    return Automaton(steps, other)


def credentials(name: str, count: int, seed: int = 7) -> list[str]:
    """Labelled credentials of a format."""
    rng = random.Random(f"{name}/{seed}")
    part = lambda p: p if isinstance(p, str) else "".join(rng.choice(p[0]) for _ in range(rng.randint(p[1], p[2])))
    return ["".join(map(part, FORMATS[name])) for _ in range(count)]


def ordinary(count: int, seed: int = 7) -> list[str]:
    """Labelled tokens that aren't credentials: names, paths, domains, versions, dates, numbers."""
    rng = random.Random(f"ordinary/{seed}")
    word = lambda: rng.choice(WORDS)

    def one() -> str:
        kind, n = rng.randrange(8), rng.randint(2, 6)
        parts = [word() for _ in range(n)]
        if kind == 0:
            return "_".join(parts)
        if kind == 1:
            return parts[0] + "".join(p.title() for p in parts[1:])
        if kind == 2:
            return "/".join(parts) + rng.choice(["", ".py", ".java", ".json", ".html", "/"])
        if kind == 3:
            return ".".join(parts)
        if kind == 4:
            return "-".join(parts) + rng.choice(["", f"-{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}"])
        if kind == 5:
            return "".join(parts)
        if kind == 6:
            return f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}" + rng.choice(["", f".{rng.randint(0, 10**6)}"])
        return rng.choice(["_", "-", "/", "."]).join([*parts, str(rng.randint(0, 10**6))]).upper() if rng.random() < 0.5 else "_".join(p.upper() for p in parts)

    return [one() for _ in range(count)]


@dataclass
class Ordinary:
    """Ordinary tokens: an automaton of the classes of their characters, beside it the odds of a class after another (for tokens of no shape that was labelled), and how frequent characters are in their class."""

    classes: Automaton
    pairs: dict[str, float]
    letters: dict[str, float]

    def score(self, text: str) -> float:
        shape = text.translate(_TO_CLASS)
        pairs = sum(self.pairs[a + b] for a, b in zip(shape, shape[1:]))
        return max(self.classes.score(shape), pairs) + sum(map(self.letters.__getitem__, text))


#: Characters' classes, by their first member.
_TO_CLASS = str.maketrans({c: group[0] for group in CLASSES for c in group})


def infer_ordinary(tokens: list[str]) -> Ordinary:
    """Upper and lower case letters are taken as equally frequent, as ordinary tokens may be written in either."""
    letters = {}
    counts = Counter("".join(tokens).lower())
    for group in CLASSES:
        total = sum(counts[c.lower()] + 1 for c in group)
        letters |= {c: math.log((counts[c.lower()] + 1) / total) for c in group}
    shapes = [t.translate(_TO_CLASS) for t in tokens]
    after = Counter(a + b for shape in shapes for a, b in zip(shape, shape[1:]))
    marks = [group[0] for group in CLASSES]
    pairs = {a + b: math.log((after[a + b] + 1) / (sum(after[a + c] for c in marks) + len(marks))) for a in marks for b in marks}
    return Ordinary(infer(shapes, unseen=1e-2), pairs, letters)


@dataclass
class Model:
    formats: dict[str, Automaton]
    ordinary: Ordinary
    threshold: float

    def score(self, text: str) -> tuple[float, str]:
        """The log-likelihood of the best format over that of ordinary tokens, and the format; what is under the threshold may be lower still."""
        plain = self.ordinary.score(text)
        best, name = max((a.score(text, plain + self.threshold), n) for n, a in self.formats.items())
        return best - plain, name


@functools.cache
def fit(per_format: int = 250, plain: int = 500) -> Model:
    """Automata of every format and of ordinary tokens, from that many labelled rows of each.

    The threshold lies in the middle between the scores of other labelled rows,
    the lowest hundredth of credentials and the highest thousandth of tokens,
    and is at least ODDS.
    """
    formats = {name: infer(credentials(name, per_format)) for name in FORMATS}
    model = Model(formats, infer_ordinary(ordinary(plain)), -math.inf)
    good = sorted(model.score(c)[0] for name in FORMATS for c in credentials(name, 50, seed=8))
    bad = sorted(model.score(c)[0] for c in ordinary(2000, seed=8))
    model.threshold = max(ODDS, (good[len(good) // 100] + bad[-1 - len(bad) // 1000]) / 2)
    return model


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the pattern kinds: leftmost matches that don't overlap within a kind, without those that are too short."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST] if ":" in text or "=" in text else []
    found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _spans(texts: list[str | None], model: Model, judge) -> list[list[dict]]:
    out = []
    for text in texts:
        found = base_spans(text or "")
        begins, reach = [x for x, _, _ in found], list(accumulate((y for _, y, _ in found), max))
        for m in CANDIDATE.finditer(text or ""):
            a, b = m.span()
            # A sentence's full stop isn't part of a credential.
            while m[0][b - a - 1] in ".-/" and b - a > 16:
                b -= 1
            before = bisect_left(begins, b)
            if not (before and reach[before - 1] > a):
                score, name = judge(text[a:b])
                if score >= model.threshold:
                    found.append((a, b, "format", name, score))
        found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
        out.append([{"kind": s[2], "start": s[0], "end": s[1], "format": s[3] if len(s) > 3 else None, "score": s[4] if len(s) > 3 else None} for s in found])
    return out


SPANS = "array<struct<kind:string,start:int,end:int,format:string,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("format", pa.string()), ("score", pa.float64())]))


def scan(docs: DataFrame, per_format: int = 250, plain: int = 500) -> DataFrame:
    """``docs`` with ``secrets``, an array of ``kind, start, end, format, score``: spans in characters of ``text``, the end exclusive.

    ``assign``, ``access`` and ``hex`` are what patterns find (whole matches);
    ``format`` are other candidates that a format's automaton finds likelier
    than ordinary tokens.  Candidates that overlap a pattern's span are left to
    it.  Order: start, then kind.

    The automata are inferred from ``per_format`` labelled credentials of each
    format and ``plain`` ordinary tokens; nothing is learned from ``docs``, so
    rows are judged alone and equal texts alike.  Null and empty texts have no
    spans; texts are whole however long; null and repeated ids are rows like
    others; no rows give none.  Extra columns of any name stay, but for one
    called ``secrets``, which is replaced.
    """
    rows, back = set_aside(docs.drop("secrets"), ("secrets",))
    model = fit(per_format, plain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = functools.lru_cache(100_000)(model.score)
        # Runs are judged however long; long ones aren't kept, so the memory has a bound.
        judge = lambda text: kept(text) if len(text) <= REMEMBERED else model.score(text)
        for batch in pieces(batches, "text"):
            spans = pa.array(_spans(batch.column("text").to_pylist(), model, judge), _SPAN_TYPE)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=[*batch.schema.names, "secrets"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, secrets {SPANS}").select(*back, "secrets")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of ``scan``'s rows: spans as ``kind:start:end``, joined by commas."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"] != "format")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    added = F.filter("secrets", lambda s: s["kind"] == "format")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans"), F.array_join(F.transform(added, lambda s: s["format"]), ",").alias("formats"))
