"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import functools
import math
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces
from .common import labelled_rows, one_text, rename_clashes
from .logistic import fit_logistic, predict

#: Letters of other alphabets that look like a Latin letter, each with that letter.
HOMOGLYPHS = {
    "а": "a", "α": "a", "в": "b", "β": "b", "с": "c", "ϲ": "c", "ԁ": "d", "е": "e", "ё": "e", "ε": "e", "һ": "h", "н": "h", "і": "i", "ι": "i", "ı": "i",
    "ј": "j", "к": "k", "κ": "k", "ӏ": "l", "м": "m", "μ": "m", "п": "n", "η": "n", "о": "o", "ο": "o", "σ": "o", "р": "p", "ρ": "p", "ԛ": "q", "г": "r",
    "ѕ": "s", "т": "t", "τ": "t", "υ": "u", "ν": "v", "ѵ": "v", "ԝ": "w", "ω": "w", "х": "x", "χ": "x", "у": "y", "γ": "y", "ᴢ": "z",
}
#: Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "idiot proof", "scum line", "pond scum", "loser bracket", "stupid good")
#: Characters that may stand inside a word to break it up.
IGNORED = "­​‌‍⁠﻿"


def _table() -> dict[int, str | None]:
    to: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalnum()}
    to |= {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
    to |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    to |= {ord(c): " " for c in " ‘’“”–—…«»¡¿"} | {ord(c): None for c in IGNORED}
    return to


_FOLD = _table()


def fold_text(text: str | None) -> str:
    """Lower case, look-alikes and digit signs as Latin letters, all other ASCII signs as spaces."""
    return f" {(text or '').lower().translate(_FOLD)} "


def terms(folded: str, least: int, most: int) -> set[str]:
    """The beginnings of the text's words (with the space before them) and the whole words (with both spaces)."""
    out = set()
    for w in set(folded.split()):
        if len(w) >= least:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in range(least, min(len(w), most) + 1))
    return out


@functools.lru_cache(maxsize=2)
def _automaton(lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    """Values are weights; an exception phrase takes back the weight of what it holds."""
    found = ahocorasick.Automaton()
    for term, weight in lexicon:
        found.add_word(term, (weight, 1))
    for phrase in exceptions:
        folded = fold_text(phrase)
        inside = [w for t, w in lexicon if t in folded]
        if inside:
            found.add_word(folded.rstrip(), (-sum(inside), -len(inside)))
    if len(found):
        found.make_automaton()
    return found


def features(text: str | None, lexicon: tuple, exceptions: tuple) -> list[float]:
    """Of the whole text: weighted matches, absolute and by length."""
    folded = fold_text(text)
    weight = hits = 0.0
    found = _automaton(lexicon, exceptions)
    if len(found):
        for _, (w, k) in found.iter(folded):
            weight += w
            hits += k
    # Every word leaves a space before it, so the spaces count the words about.
    n = folded.count(" ")
    weight, hits = max(weight, 0.0), max(hits, 0.0)
    return [math.log1p(weight), min(hits, 4.0), math.log1p(100 * weight / (n + 5))]


WIDTH = 3


def choose_terms(pos: dict[str, int], neg: dict[str, int], n_pos: int, n_neg: int, odds: float) -> tuple[tuple[str, float], ...]:
    """Terms of enough log odds, with these as weights, from the numbers of toxic and of other texts that hold them.

    Of nested terms the longest that loses under a tenth of the texts stays,
    and of those the shortest.
    """
    weight = {t: math.log((p + 0.5) / (n_pos + 1)) - math.log((neg.get(t, 0) + 0.5) / (n_neg + 1)) for t, p in pos.items()}
    strong = {t for t, w in weight.items() if w >= odds}
    shadowed = {t[:k] for t in strong for k in range(2, len(t)) if t[:k] in strong and pos[t] >= 0.9 * pos[t[:k]]}
    kept: dict[str, float] = {}
    for t in sorted(strong - shadowed, key=lambda t: (len(t), t)):
        if not any(t[:k] in kept for k in range(2, len(t))):
            kept[t] = weight[t]
    return tuple(sorted(kept.items()))


def learn_lexicon(sample: DataFrame, least: int = 4, most: int = 9, support: float = 0.01, odds: float = 2.5) -> tuple[tuple[str, float], ...]:
    """Terms that mark toxic texts, with their log odds as weights, see ``choose_terms``.

    ``sample(label, text)`` is a bounded set of labelled rows.  Terms are word
    beginnings and whole words in at least ``support`` of the toxic texts; so
    many texts hold few of them, which bounds what comes to the driver.
    """

    def count(wanted: frozenset | None):
        def run(batches):
            seen, n = Counter(), 0
            for batch in pieces(batches, "text"):
                for t in batch.column("text").to_pylist():
                    got = terms(fold_text(t), least, most)
                    seen.update(got if wanted is None else got & wanted)
                    n += 1
            seen[""] = n
            yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())})

        return run

    def counted(label: int, wanted: frozenset | None, at_least: int) -> dict[str, int]:
        got = sample.filter(F.col("label") == label).select("text").mapInArrow(count(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        return {r["term"]: r["n"] for r in got.filter((F.col("n") >= at_least) | (F.col("term") == "")).collect()}

    toxic_rows = sample.filter("label = 1").count()
    pos = counted(1, None, max(3, math.ceil(support * toxic_rows)))
    neg = counted(0, frozenset(pos), 1)
    n_pos, n_neg = pos.pop("", 0), neg.pop("", 0)
    return choose_terms(pos, neg, n_pos, n_neg, odds)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 2000, other_rows: int = 6000, fit_rows: int = 12_000, exceptions: tuple[str, ...] = EXCEPTIONS) -> dict:
    """Fit on a bounded sample of labelled rows, chosen by a hash of the ids.

    ``labels(doc_id, label)`` holds 1 for toxic; nulls are left out, of several
    labels of an id the highest counts.  A hash of the ids splits the labelled
    rows: ``toxic_rows`` and ``other_rows`` whole texts of two thirds give the
    lexicon, ``fit_rows`` whole texts of the last third calibrate the score, so
    no text is used for both.  Of rows that repeat an id the text of the least
    hash counts.  No labelled rows give an empty lexicon and a score of 0.5.
    ``learned`` is false if the lexicon is empty or the calibration saw only one
    label: then all texts score alike, and no score says anything.
    """
    rows = labelled_rows(labels, 9)
    first = F.col("h") % 3 != 0
    chosen = [rows.filter(first & (F.col("label") == label)).orderBy("h", "doc_id").limit(n) for label, n in ((1, toxic_rows), (0, other_rows))]
    # ids: toxic_rows + other_rows at most.
    lexicon = learn_lexicon(one_text(docs, chosen[0].union(chosen[1])))

    def run(batches):
        for batch in pieces(batches, "text"):
            f = np.array([features(t, lexicon, exceptions) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *[pa.array(f[:, i]) for i in range(WIDTH)]], names=["doc_id", "label", "f0", "f1", "f2"])

    # ids: fit_rows at most; three numbers for each come to the driver.
    held = one_text(docs, rows.filter(~first).orderBy("h", "doc_id").limit(fit_rows))
    got = sorted(tuple(r) for r in held.mapInArrow(run, "doc_id string, label int, f0 double, f1 double, f2 double").collect())
    model = fit_logistic(np.array([r[2:] for r in got]).reshape(len(got), WIDTH), np.array([r[1] for r in got]))
    return {"lexicon": lexicon, "exceptions": tuple(exceptions), "logistic": model, "learned": bool(lexicon) and {r[1] for r in got} == {0, 1}}


def score(docs: DataFrame, model: dict, name: str = "score", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``name`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 if ``name`` >= ``threshold``).

    Whole texts are folded and matched, a batch of about 4 MB at a time.  Null
    and empty texts score as a text of no words without a match.  Null and
    repeated ids are rows like others, an empty table gives no rows.  Columns
    of those two names are replaced; all others pass through.
    """
    docs = rename_clashes(docs, [name, "predicted"])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in pieces(batches, "text"):
            f = np.array([features(t, model["lexicon"], model["exceptions"]) for t in batch.column("text").to_pylist()]).reshape(batch.num_rows, WIDTH)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predict(model["logistic"], f))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col(name) >= threshold).cast("int"))
