"""Periodic runs of words: maximal stretches whose words repeat at a distance.

A suffix automaton grows word by word. Its suffix links form a tree kept as a
link-cut tree whose preferred paths are segments of one colour: the place
where their strings ended last. Appending word i accesses the path of the new
prefix; every segment met on the way (deepest length l, last end e) says that
the longest suffix shared with the prefix ending at e has l words. If the
distance d = i - e is at most l, the last l + d words have the smallest period
d, and reach as far left as that period does: a square, extended to a run by
the words that follow. The path then takes the colour i.

Before that, a text is split at the words that no run can hold: in a run of
exponent x every word pair recurs x - 1 times (and so does every triple, if
runs are longer than x words), so words covered by no such pair or triple part
the text, again and again, until each piece is covered. This is exact; the
automaton sees every piece that is left. Texts are independent rows: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import scratch

Run = tuple[int, int, int]  # start, length, period

RUNS = "array<struct<start:long,length:long,period:long>>"
#: Pieces up to this many words go to the automaton at once.
SHORT = 48


class SuffixTree:
    """Suffix automaton of the words so far, its links as a link-cut tree.

    State 0 is the automaton's root and stands for no node in the tree. A
    node that heads its splay tree holds the segment's colour, and ``up``
    leads from there to the segment above.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.left, self.right, self.up, self.colour = [0], [0], [0], [0]
        self.last = 0

    def _state(self, length: int, link: int, following: dict) -> int:
        for column, value in ((self.next, following), (self.link, link), (self.length, length), (self.left, 0),
                              (self.right, 0), (self.up, 0), (self.colour, 0)):
            column.append(value)
        return len(self.link) - 1

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[g] == p and g:
            left[g] = x
        elif right[g] == p and g:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]
        if left[p] == x:
            moved = left[p] = right[x]
            right[x] = p
        else:
            moved = right[p] = left[x]
            left[x] = p
        if moved:
            up[moved] = p
        up[p], up[x] = x, g

    def _splay(self, x: int) -> None:
        left, right, up, rotate = self.left, self.right, self.up, self._rotate
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                rotate(p if (left[g] == p) == (left[p] == x) else x)
            rotate(x)

    def append(self, word: int) -> Iterator[tuple[int, int]]:
        """Add a word; yields (distance to the last end, deepest length) of the segments met."""
        nexts, link, length = self.next, self.link, self.length
        end = length[self.last] + 1
        new = self._state(end, 0, {})
        p = self.last
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            if length[q] > length[p] + 1:
                q = self._part(p, q, word)
            link[new] = self.up[new] = q
        self.last = new
        # access: every segment on the way gives up what hangs below, and joins the path
        below, node = 0, new
        while node:
            self._splay(node)
            colour = self.colour[node]
            if colour:
                yield end - colour, length[node]
            cut = self.right[node]
            if cut:
                self.colour[cut] = colour
            self.right[node] = below
            if below:
                self.up[below] = node
            below, node = node, self.up[node]
        self.colour[below] = end

    def _part(self, p: int, q: int, word: int) -> int:
        """Part the shorter strings of q off, as a node just above it in its segment."""
        nexts, link = self.next, self.link
        clone = self._state(self.length[p] + 1, link[q], nexts[q].copy())
        self._splay(q)
        above = self.left[q]
        self.left[clone], self.left[q], self.up[clone] = above, clone, q
        if above:
            self.up[above] = clone
        link[q] = clone
        while p >= 0 and nexts[p].get(word) == q:
            nexts[p][word] = clone
            p = link[p]
        return clone


def piece_runs(words: Sequence[int], least: int, exponent: int) -> list[Run]:
    """Runs of at least ``least`` words and ``exponent`` periods."""
    tree, ends = SuffixTree(), {}
    for i, word in enumerate(words):
        for distance, length in tree.append(word):
            if distance <= length and length + distance >= max(least, exponent * distance):
                ends[i + 1 - length - distance, distance] = i + 1
    return [(start, end - start, period) for (start, period), end in ends.items()]


def _recurring(words: np.ndarray, gram: int, times: int) -> np.ndarray:
    """Which words are covered by a word ``gram``-tuple that occurs ``times`` times."""
    n = len(words) - gram + 1
    codes = words[:n].astype(np.int64)
    for k in range(1, gram):
        codes = np.unique(codes * (int(words.max()) + 1) + words[k:k + n], return_inverse=True)[1]
    often = np.bincount(codes)[codes] >= times
    covered = np.zeros(len(words), dtype=bool)
    for k in range(gram):
        covered[k:k + n] |= often
    return covered


def runs_of(words: Sequence[int], least: int = 6, exponent: int = 4) -> list[Run]:
    """All runs of a text of coded words, by start, then period."""
    gram = 3 if least > exponent else 2
    out: list[Run] = []
    pieces = [(0, np.asarray(words, dtype=np.int64))]
    while pieces:
        at, piece = pieces.pop()
        if len(piece) < max(least, exponent):
            continue
        if len(piece) <= SHORT and at:
            covered = np.ones(len(piece), dtype=bool)
        else:
            covered = _recurring(piece, gram, exponent - 1)
        if covered.all():
            out += [(at + start, length, period) for start, length, period in piece_runs(piece.tolist(), least, exponent)]
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
        pieces += [(at + int(a), piece[a:b]) for a, b in zip(edges[::2], edges[1::2])]
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words: Sequence, runs: Sequence[Run]) -> list:
    """The words that are first of their kind in every run that holds them."""
    dropped = bytearray(len(words))
    for start, length, period in runs:
        dropped[start + period:start + length] = b"\1" * (length - period)
    return [w for w, d in zip(words, dropped) if not d]


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """One row per input row: key, n_words, runs (start, length and smallest
    period of every run of at least ``least`` words and ``exponent`` periods,
    by start, then period; words from 0) and collapsed (the text's words
    without what a run repeats, joined by one space).

    Words are maximal runs of characters other than ASCII white space. Null or
    empty text: no words, no runs, collapsed empty. Null key and repeated rows:
    each row on its own. Empty table: empty result. Other columns are not
    looked at. Very long texts are held one at a time; the automaton has at
    most two states per word.
    """
    if least < 2 or exponent < 3:
        raise ValueError("runs hold at least two words and three periods")
    scratch(docs.sparkSession, "periodic")  # the workers need this package
    arrow_key = to_arrow_type(docs.schema[key].dataType)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, found, collapsed = [], [], []
            for t in b.column(1):
                t = t.as_py()
                words = t.encode().split() if t else []  # bytes split at ASCII white space only
                codes: dict[bytes, int] = {}
                runs = runs_of([codes.setdefault(w, len(codes)) for w in words], least, exponent) if len(words) >= least else []
                sizes.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                collapsed.append(b" ".join(without_repeats(words, runs) if runs else words).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(arrow_key), pa.array(sizes, pa.int64()), pa.array(found, run_type), pa.array(collapsed, pa.string())],
                ["key", "n_words", "runs", "collapsed"],
            )

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        find, f"key {docs.schema[key].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string"
    )
    return out.withColumnRenamed("key", key)
