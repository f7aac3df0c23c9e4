"""Byte-level BPE by tree reduction: halves are encoded apart and joined at the seam."""

from __future__ import annotations

import base64
import functools
from dataclasses import dataclass

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import add_columns
from .common import rename_clashes

#: Characters up to which a text is encoded in one go.
LEAF = 8192
#: Bytes up to which one match of the pattern is merged in one go.
PIECE_LEAF = 256

#: Matches at a part's end that it remembers, and blanks behind a match that are looked through for its end.
TAIL, BLANKS = 6, 4096


@dataclass
class Part:
    """The ids of ``begin`` to ``end`` of a text, with its first match of the pattern and its last ones: start, end and number of ids.

    ``whole``: ``tail`` has all matches.
    """

    ids: list[int]
    begin: int
    end: int
    head: tuple[int, int, int]
    tail: list[tuple[int, int, int]]
    whole: bool


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class Codec:
    """Encoder and decoder of whole texts for one file of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, piece_leaf: int = PIECE_LEAF):
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes = {i: b for b, i in ranks.items()}
        self.leaf, self.piece_leaf = leaf, piece_leaf

    # One match of the pattern, as bytes.

    def _merge(self, piece: bytes) -> list[int]:
        return self.encoding._core_bpe.encode_single_piece(piece)

    def _fits(self, a: int, b: int) -> bool:
        """Whether b may follow a.  A sequence in which every token may follow the one before it is what merging the bytes gives."""
        return self._merge(self.bytes[a] + self.bytes[b]) == [a, b]

    def encode_piece(self, piece: bytes) -> list[int]:
        if len(piece) <= self.piece_leaf:
            return self._merge(piece)
        middle = len(piece) // 2
        return self.join_piece(self.encode_piece(piece[:middle]), self.encode_piece(piece[middle:]))

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        """Merge a window around the seam anew, wider each time, until its first and last tokens fit their neighbours outside.

        Then every two neighbours of the whole fit, so the tokens outside are final.
        """
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self._merge(b"".join(map(self.bytes.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self._fits(left[i - 1], window[0])) and (j == len(right) or self._fits(window[-1], right[j])):
                return left[:i] + window + right[j:]
            width *= 2

    # Whole texts.

    def encode(self, text: str) -> list[int]:
        """Ids of the text: of its halves, joined."""
        if len(text) <= self.leaf:
            return self.encoding.encode_ordinary(text)
        return self._part(text, 0, len(text)).ids

    def _part(self, text: str, begin: int, end: int) -> Part:
        if end - begin > self.leaf:
            middle = (begin + end) // 2
            return self.join(text, self._part(text, begin, middle), self._part(text, middle, end))
        spans = [m.span() for m in self.pattern.finditer(text, begin, end)]
        ids = self.encoding.encode_ordinary(text[begin:end])
        tail = self._counted(text, spans[-TAIL:], ids) if len(spans) > 1 else [(begin, end, len(ids))]
        return Part(ids, begin, end, tail[0] if len(spans) <= TAIL else self._counted(text, spans[:1], ids, False)[0], tail, len(spans) <= TAIL)

    def _counted(self, text: str, spans: list[tuple[int, int]], ids: list[int], last: bool = True) -> list[tuple[int, int, int]]:
        """The last matches of a part (or its first ones), with how many of its ids each has."""
        out, k = [], 0
        for a, b in reversed(spans) if last else spans:
            size, began = len(text[a:b].encode()), k
            while size > 0:
                size -= len(self.bytes[ids[-1 - k if last else k]])
                k += 1
            out.append((a, b, k - began))
        return out[::-1] if last else out

    def join(self, text: str, left: Part, right: Part) -> Part:
        """Match the pattern anew around the seam, from the first match of ``left`` that what follows may change to the first end of a match that is one in ``right`` too.

        A match is final if the pattern saw its end: it looks at most one
        character beyond, or to the end of the blanks behind.  From a common
        end on all matches are those of ``right``, as no match looks back.
        """
        seam, end = left.end, right.end
        sure = len(text[max(left.begin, seam - BLANKS) : seam].rstrip()) + max(left.begin, seam - BLANKS) - 1
        open_at = next((k for k, (_, to, _) in enumerate(left.tail) if to >= sure), None)
        if open_at is None or (open_at == 0 and not left.whole):
            # More matches are open than are remembered: all of the left half is matched anew.
            spans = [m.span() for m in self.pattern.finditer(text, left.begin, seam)]
            left = Part(left.ids, left.begin, seam, left.head, self._counted(text, spans, left.ids), True)
            open_at = next((k for k, (_, to, _) in enumerate(left.tail) if to >= sure and not text[to:seam].strip()), 0)
        opened = left.tail[open_at:]
        start = opened[0][0]
        theirs = self.pattern.finditer(text, seam, end)
        passed: list[tuple[int, int, int]] = []  # matches of the right half that are matched anew
        reach, made = seam, []
        for m in self.pattern.finditer(text, start, end):
            made.append(m.span())
            while reach < m.end():
                a, reach = next(theirs).span()
                passed.append((a, reach, right.head[2] if a == seam else -1))
            if m.end() >= seam and reach == m.end():
                break
        passed = [p if p[2] >= 0 else (p[0], p[1], len(self.encode_piece(text[p[0] : p[1]].encode()))) for p in passed]
        gone, came = sum(n for *_, n in opened), sum(n for *_, n in passed)
        old = left.ids[len(left.ids) - gone :] + right.ids[:came]
        known = [*opened, *passed]
        new, spans, at, k = [], [], 0, 0
        for a, b in made:
            # The matches of the halves that begin within this one, and their ids.
            inside, here = [], at
            while k < len(known) and known[k][0] < b:
                inside.append((known[k], old[here : here + known[k][2]]))
                here += known[k][2]
                k += 1
            at = here
            if b - a > self.piece_leaf and inside and inside[0][0][0] == a and inside[-1][0][1] == b:
                ids = functools.reduce(self.join_piece, [x for _, x in inside])
            else:
                ids = self.encode_piece(text[a:b].encode())
            new += ids
            spans.append((a, b, len(ids)))
        rest = [t for t in right.tail if t[0] >= reach]
        covered = right.whole or right.tail[0][0] <= reach
        tail = [*left.tail[:open_at], *spans, *rest] if covered else rest
        head = spans[0] if start == left.begin else left.head
        return Part(left.ids[: len(left.ids) - gone] + new + right.ids[came:], left.begin, end, head, tail[-TAIL:], covered and left.whole and len(tail) <= TAIL)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: of their halves, concatenated."""
        if len(ids) <= self.leaf:
            return self.encoding.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str, leaf: int = LEAF) -> Codec:
    return Codec(load_ranks(path), pattern, leaf)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids", leaf: int = LEAF) -> DataFrame:
    """``docs`` with ``name``: the token ids of every whole text (null: of an empty text, so none).

    Texts of up to ``leaf`` characters are leaves; longer ones, however long,
    are halved and the halves joined (see ``Codec.join``).  Empty texts give an
    empty array.  Null and repeated ids are rows like others, equal texts have
    equal ids, and no rows give none.  A column called ``name`` is replaced,
    all others pass through.
    """
    docs = rename_clashes(docs, [name])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def make(texts):
        c = codec(path, pattern, leaf)
        return [pa.array([c.encode(t or "") for t in texts], pa.list_(pa.int32()))]

    return docs.mapInArrow(add_columns(make, text, [name], 1_000_000), schema)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids", back: str = "decoded", leaf: int = LEAF) -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that each task needs one Python worker: the ids, and the bytes they decode to."""
    docs = rename_clashes(docs, [name, back])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType())), T.StructField(back, T.BinaryType())])

    def make(texts):
        c = codec(path, pattern, leaf)
        ids = [c.encode(t or "") for t in texts]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.binary())]

    return docs.mapInArrow(add_columns(make, text, [name, back], 1_000_000), schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids", same: str = "round_trip", leaf: int = LEAF) -> DataFrame:
    """``encode`` and ``decode`` in one pass: the ids, and whether they decode to the text's bytes."""
    docs = rename_clashes(docs, [name, same])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType())), T.StructField(same, T.BooleanType())])

    def make(texts):
        c = codec(path, pattern, leaf)
        ids = [c.encode(t or "") for t in texts]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) == (t or "").encode() for x, t in zip(ids, texts, strict=True)], pa.bool_())]

    return docs.mapInArrow(add_columns(make, text, [name, same], 1_000_000), schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", name: str = "decoded", leaf: int = LEAF) -> DataFrame:
    """``docs`` with ``name``: the bytes that the token ids stand for (null: none)."""
    docs = rename_clashes(docs, [name])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])

    def make(lists):
        c = codec(path, pattern, leaf)
        return [pa.array([c.decode(x or []) for x in lists], pa.binary())]

    return docs.mapInArrow(add_columns(make, ids, [name], 4_000_000), schema)
