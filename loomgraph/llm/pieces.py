"""Problem 5: cutting oversized texts at natural boundaries, with overlap.

Recursive bisection: a span over the limit is cut at the strongest boundary near its
middle (blank line, sentence end, whitespace, then anywhere between two code points),
and the halves are cut again until each fits the limit minus the overlap; the overlap
is attached afterwards, moved inward to a natural boundary. The same bisection without
overlap, free to cut anywhere in a span, tells the coarsest boundary that suffices: it
is the weakest one that it had to use.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.sentences import Model, boundaries
from loomgraph.plans.runtime import ship, spread

LIMIT, OVERLAP = 2000, 200
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_SPACE = re.compile(r"\s+")
LEVELS = ("paragraph", "sentence", "word", "none")


class Cuts:
    """Boundaries of one text by strength; each is an offset at which a piece may begin."""

    def __init__(self, text: str, ends: list[int]):
        self.text = text
        self.by = [
            [x.end() for x in _BLANK.finditer(text) if 0 < x.end() < len(text)],
            [self._next(e) for e in ends if self._next(e) < len(text)],
            [x.end() for x in _SPACE.finditer(text) if 0 < x.end() < len(text)],
        ]

    def _next(self, e: int) -> int:
        while e < len(self.text) and self.text[e].isspace():
            e += 1
        return e

    def best(self, lo: int, hi: int, reach: int) -> tuple[int, int]:
        """(offset, level) of the strongest boundary within ``reach`` of the middle of the span, else anywhere in it, else the middle."""
        mid = (lo + hi) // 2
        for r in (reach, hi - lo):
            for k, at in enumerate(self.by):
                a, b = bisect_right(at, max(lo, mid - r)), bisect_left(at, min(hi, mid + r))
                if a < b:
                    m = bisect_left(at, mid, a, b)
                    return min(at[max(a, m - 1) : min(b, m + 1)], key=lambda x: (abs(x - mid), x)), k
        return mid, len(self.by)

    def length(self, lo: int, hi: int) -> int:
        """Length of a span without the blanks at its ends."""
        while lo < hi and self.text[lo].isspace():
            lo += 1
        while hi > lo and self.text[hi - 1].isspace():
            hi -= 1
        return hi - lo

    def overlap(self, lo: int, cut: int, width: int) -> int:
        """Start of the repeated tail before ``cut``: ``width`` long at most, at the strongest boundary in its first half, else the first one."""
        far = max(lo, cut - width)
        if far == 0:
            return far
        for at in self.by[1:]:
            a = bisect_left(at, far)
            if a < len(at) and at[a] < cut and (at is self.by[2] or at[a] <= far + width // 2):
                return at[a]
        return far


def bisect_spans(c: Cuts, fits, reach: float) -> tuple[list[tuple[int, int]], int]:
    """(spans, weakest level used): spans that do not fit are cut at the strongest boundary within ``reach`` (a share of the span) of the middle, and their halves again."""
    todo, own, weakest = [(0, len(c.text))], [], 0
    while todo:
        lo, hi = todo.pop()
        if fits(lo, hi):
            own.append((lo, hi))
        else:
            x, k = c.best(lo, hi, int((hi - lo) * reach))
            weakest = max(weakest, k)
            todo += [(x, hi), (lo, x)]
    return own, weakest


def cut(text: str, ends: list[int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces (start, own_start, end): text[start:own_start] repeats the piece before."""
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    c = Cuts(text, ends)
    own, _ = bisect_spans(c, lambda lo, hi: hi - lo <= (limit if lo == 0 else limit - overlap), 0.25)
    return [(c.overlap(own[i - 1][0], lo, overlap) if i else lo, lo, hi) for i, (lo, hi) in enumerate(own)]


def level(text: str, ends: list[int], limit: int = LIMIT) -> str:
    """The coarsest boundary that suffices: the weakest that the bisection without overlap has to use."""
    c = Cuts(text, ends)
    return LEVELS[bisect_spans(c, lambda lo, hi: c.length(lo, hi) <= limit, 1.0)[1]]


def _long(df: DataFrame, limit: int) -> DataFrame:
    return spread(df.select("id", "text", "lang").where(F.length("text") > limit))


def cut_levels(df: DataFrame, model: Model, limit: int = LIMIT) -> DataFrame:
    """(id, text, lang) -> (id, cut_at) of the texts longer than ``limit``; an id counts once, NULL text is never long."""
    ship(df.sparkSession)
    schema = pa.schema([("id", pa.string()), ("cut_at", pa.string())])

    def run(batches):
        for b in batches:
            rows = [level(t, boundaries(t, g, model), limit) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.string())], schema=schema)

    return _long(df, limit).mapInArrow(run, "id string, cut_at string").dropDuplicates(["id"])


def cut_pieces(df: DataFrame, model: Model, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, text, lang) -> (id, piece_no, start_pos, own_pos, end_pos, text) of the texts longer than ``limit``.

    Every piece has at most ``limit`` code points; from the second on it begins with a
    repeat of at most ``overlap`` from the piece before (``own_pos`` is where its own
    text begins). The own parts joined give back the text. An id counts once.
    """
    ship(df.sparkSession)
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below limit")
    schema = pa.schema([("id", pa.string()), ("piece_no", pa.int64()), ("start_pos", pa.int64()), ("own_pos", pa.int64()), ("end_pos", pa.int64()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for i, t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                out += [(i, n, a, o, z, t[a:z]) for n, (a, o, z) in enumerate(cut(t, boundaries(t, g, model), limit, overlap))]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    one = _long(df, limit).dropDuplicates(["id"])
    return one.mapInArrow(run, "id string, piece_no bigint, start_pos bigint, own_pos bigint, end_pos bigint, text string")
