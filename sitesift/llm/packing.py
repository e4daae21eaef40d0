"""Packing token streams of several sources into fixed windows of a target mixture.

The documents of a source form a queue. Deficit round-robin serves the
queues: in every window (a round) each source's quantum, its share of the
window, is added to its deficit, whole tokens are sent and the fraction is
carried on. So after window k source j has sent floor(n_j * g_k / P) of its
n_j tokens, g_k being the tokens due by then of P in all. That closed form
places any token without running the rounds: a task needs the plan and the
number of tokens queued before its document, and carries no state from any
other task. When the target weights drain a queue early, the others go on by
weight in a new phase, until all tokens are packed.

Windows follow each other without gaps; the stream is cut every
``sequence`` tokens and its rest into powers of two, so nothing is padded.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import KEPT_CHARS, sliced, stage

MAX_SOURCES = 10_000
#: Rows of the table of queue offsets (parts x sources) that may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000
#: Words of the text a worker remembers, and keeps for later stages.
CACHE_WORDS = 250_000

# Here tiktoken and tokenizers agree: characters of ASCII and the Latin blocks, no special string.
_LATIN = r"\x21-\x7e\xa1-\xac\xae-\u024f"
_PLAIN = re.compile(rf"[{_LATIN} \n]*")
_SINGLE_GAPS = re.compile(rf"[{_LATIN}]+(?:[ \n][{_LATIN}]+)*")


class ByteTokenizer:
    """Ids of a byte-level BPE file. White space starts a pre-token, so in
    ordinary text a word with the one space or line break before it has ids of
    its own, which are remembered; all other text goes to the libraries whole."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words(_ranked(ranks), self.code) if ranks else None

    def __call__(self, text: str) -> bytes:
        """Ids as unsigned integers of the machine's order, 16 or 32 bits wide by vocabulary."""
        if not text:
            return b""
        if self.words is not None and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            if _SINGLE_GAPS.fullmatch(text):
                first, *rest = text.replace("\n", " \n").split(" ")
                return self.words.pack(first) + b"".join(map(self.words.__getitem__, rest))
            return self.words.pack(text)
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class _Words(dict):
    def __init__(self, encoding, code: str):
        super().__init__()
        self.encode, self.code = encoding.encode_ordinary, code

    def pack(self, text: str) -> bytes:
        return array(self.code, self.encode(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        got = self.pack(word if word[0] == "\n" else " " + word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = got
        return got


def _ranked(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def byte_tokenizer(path: str, ranks: str | None) -> ByteTokenizer:
    return ByteTokenizer(path, ranks)


class Plan:
    """Where the tokens of each queue go. ``totals``: tokens of each source;
    ``weights``: target weight of each (its total if not given)."""

    def __init__(self, totals: list[int], weights: list[float] | None, window: int, sequence: int):
        self.window, self.sequence, self.size = window, sequence, sum(totals)
        left, share = list(totals), [Fraction(w) for w in (totals if weights is None else weights)]
        self.phases: list[tuple[int, int, list[int], list[int]]] = []  # first position, tokens, tokens by source, queued before
        at = 0
        while at < self.size:
            active = [j for j, n in enumerate(left) if n and share[j] > 0]
            if not active:  # no weight at all: what is left goes by size
                share = [Fraction(n) for n in left]
                continue
            rounds = min(left[j] / share[j] for j in active)
            part = [min(left[j], round(share[j] * rounds)) if share[j] > 0 else 0 for j in range(len(left))]
            self.phases.append((at, sum(part), part, [a - b for a, b in zip(totals, left)]))
            left = [a - b for a, b in zip(left, part)]
            at += sum(part)
        self.full = self.size // sequence
        rest = self.size - self.full * sequence
        self.tail = [self.full * sequence]  # starts of the last sequences
        for bit in reversed(range(sequence.bit_length())):
            if rest >> bit & 1:
                self.tail.append(self.tail[-1] + (1 << bit))

    def sequence_of(self, at: int) -> tuple[int, int, int]:
        """(sequence, offset, tokens up to its end) of a stream position."""
        if at < self.tail[0]:
            s, o = divmod(at, self.sequence)
            return s, o, self.sequence - o
        k = bisect_right(self.tail, at) - 1
        return self.full + k, at - self.tail[k], self.tail[k + 1] - at

    def pieces(self, j: int, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the run, length, sequence, offset) of ``length`` tokens of
        source ``j`` from ``start`` in its queue."""
        done = 0
        for first, size, part, before in self.phases:
            while done < length and before[j] <= start + done < before[j] + part[j]:
                x = start + done - before[j]
                due = -((-(x + 1) * size) // part[j])  # tokens due when x is sent
                g1 = min(-(-due // self.window) * self.window, size)
                g0 = (g1 - 1) // self.window * self.window
                sent0 = [n * g0 // size for n in part[: j + 1]]
                sent1 = [n * g1 // size for n in part[: j + 1]]
                at = first + sum(sent1[:j]) + sent0[j] + sum(n * g0 // size for n in part[j + 1:]) + (x - sent0[j])
                run = min(length - done, sent1[j] - x)
                while run:
                    s, o, room = self.sequence_of(at)
                    n = min(run, room)
                    yield done, n, s, o
                    done, at, run = done + n, at + n, run - n


def _encode(path: str, ranks: str | None, end: int, key_type: pa.DataType):
    names = ["key", "source", "part", "queued", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, queued = byte_tokenizer(path, ranks), TaskContext.get().partitionId(), {}
        stop = array(encode.code, [end]).tobytes()
        for b in sliced(batches):
            sources = b.column(1).to_pylist()
            ids = [encode(t or "") + stop for t in b.column(2).to_pylist()]
            ns, starts = [len(i) // len(stop) for i in ids], []
            for s, n in zip(sources, ns):
                starts.append(queued.get(s, 0))
                queued[s] = starts[-1] + n
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(key_type), pa.array(sources, pa.string()), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(ns, pa.int64()), pa.array(ids, pa.binary())], names)

    return run


def tokenise(docs: DataFrame, path: str, ranks: str | None, *, key: str, source: str, text: str, end: int) -> DataFrame:
    """Staged rows (key, source, part, queued, n, ids): ids end with ``end``;
    ``queued`` counts the tokens of the same source earlier in the same part.
    Null or empty text: ``end`` alone."""
    run = _encode(path, ranks, end, to_arrow_type(docs.schema[key].dataType))
    schema = f"key {docs.schema[key].dataType.simpleString()}, source string, part int, queued long, n long, ids binary"
    return stage(docs.select(F.col(key), F.col(source).cast("string"), F.col(text)).mapInArrow(run, schema), "token-queues")


def _cut(plan: Plan, names: Mapping[str | None, int], key_type: pa.DataType):
    columns = [("key", key_type), ("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
               ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[list] = [[] for _ in columns]
            size = 0
            for k, s, n, ids, at in zip(*(c.to_pylist() for c in b.columns)):
                wide = np.frombuffer(ids, np.uint16 if len(ids) == 2 * n else np.uint32).astype("<u4").tobytes()
                for start, length, seq, offset in plan.pieces(names[s], at, n):
                    for c, v in zip(out, (k, s, start, length, wide[4 * start: 4 * (start + length)], n, seq, offset)):
                        c.append(v)
                size += len(wide)
                if size >= 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, columns)], [c for c, _ in columns])
                    out, size = [[] for _ in columns], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, columns)], [c for c, _ in columns])

    return run


def pack(docs: DataFrame, path: str, *, ranks: str | None = None, weights: Mapping[str | None, float] | None = None, sequence: int = 1024,
         window_sequences: int = 32, end: int = 0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per piece: key, source, start (in the document), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``weights`` are the target proportions by source; without them every
    window mirrors the whole input. ``path`` is the tokenizer file, ``ranks``
    the same vocabulary as ranks, with which ordinary text is encoded faster.

    Null or empty text: one piece of the end id. Null source: a source of its
    own. Null key and repeated rows: packed row by row. Empty table: empty
    result. Other columns are not looked at.
    """
    if sequence & (sequence - 1):
        raise ValueError("sequence is a power of two")
    rows = tokenise(docs, path, ranks, key=key, source=source, text=text, end=end)
    queues = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    totals = sorted(
        ((r.source, r.n) for r in queues.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()),
        key=lambda r: (r[0] is None, r[0] or ""),
    )
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = {s: j for j, (s, _) in enumerate(totals)}
    plan = Plan([n for _, n in totals], None if weights is None else [weights.get(s, 0) for s, _ in totals], sequence * window_sequences, sequence)
    base = stage(
        queues.select(
            F.col("source").alias("s"), F.col("part").alias("p"),
            (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("base"),
        ),
        "queue-offsets",
    )
    if base.count() <= MAX_BROADCAST_ROWS:
        base = F.broadcast(base)
    placed = rows.join(base, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).select(
        "key", "source", "n", "ids", (F.col("base") + F.col("queued")).alias("at")
    )
    cut = _cut(plan, names, to_arrow_type(docs.schema[key].dataType))
    schema = f"key {docs.schema[key].dataType.simpleString()}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(cut, schema).withColumnRenamed("key", key)
