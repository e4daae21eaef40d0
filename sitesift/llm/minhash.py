"""MinHash near-duplicates with sequential Bayesian verification.

A document is its set of five-word shingles. Texts of equal words are one
class. Classes that share a band of their MinHash signature are candidates;
signatures are compared in batches, and a pair is given up as soon as the
posterior probability that its similarity reaches the threshold falls under
the chosen miss probability. Survivors are verified on their full sets.

Only components are asked for, so not every candidate pair needs a verdict:
first each bucket's members meet its smallest one; then, in buckets that still
hold several components, tiles of members meet, with their texts. A tile pair
goes through its pairs of different components, most similar first, prunes
them by signature, verifies the rest on full sets, and skips those that links
found on the way have connected. Each pair is looked at in the first band it
shares. So at the end every candidate pair is within a component, pruned, or
refused on its full sets.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import KEPT_CHARS, SLICE, fresh, sliced, stage
from .graph import components

SHINGLE = 5
HASHES, BATCH = 125, 25
TILE = 1024
#: Words of the text a task remembers.
TASK_WORDS = 50_000
#: Candidate keys (16 bytes each) that may be broadcast to pick candidate texts.
MAX_BROADCAST_ROWS = 2_000_000

_random = np.random.RandomState(20)
_A = _random.randint(0, 1 << 62, HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.randint(0, 1 << 62, HASHES).astype(np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= TASK_WORDS:
                self.clear()
            self[word] = got
        return got


def normal_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes know ASCII letters and white space only."""
    return text.encode().lower().split() if text else []


def class_key(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words)).digest()


def shingles(words: list[bytes], known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle."""
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + b" ".join(words))] if words else [], np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - SHINGLE + 1
    x = h[:n].copy()
    for k in range(1, SHINGLE):
        x = x * _M + h[k: n + k]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return np.unique(x)


def signature(own: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(own), 4096):
        x = np.multiply.outer(_A, own[k: k + 4096])
        x += _B[:, None]
        x >>= np.uint64(32)
        low = np.minimum(low, x.min(axis=1).astype(np.uint32))
    return low


def similar(u: np.ndarray, v: np.ndarray, part: int, whole: int) -> bool:
    """Exact verdict on two sorted sets; the sizes alone refuse most far pairs."""
    small, large = (u, v) if len(u) <= len(v) else (v, u)
    if whole * len(small) < part * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return whole * both >= part * (len(u) + len(v) - both)


def least_matches(threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes seen, fewest matches to go on) after each batch: with a uniform
    prior, below that P(similarity >= threshold | matches) < miss."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = 0
        # Beta(m + 1, n - m + 1) reaches t with the chance that n + 1 trials at t have at most m hits
        while sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1)) < miss:
            m += 1
        out.append((n, m))
    return out


def banding(threshold: float, miss: float) -> tuple[int, int]:
    """(bands, rows): the longest rows, and so the fewest candidates, of which a
    pair at the threshold shares no band with a chance of at most ``miss``."""
    for rows in range(HASHES, 0, -1):
        bands = HASHES // rows
        if (1 - threshold**rows) ** bands <= miss:
            return bands, rows
    raise ValueError(f"{HASHES} hashes cannot find pairs at {threshold} with a miss of {miss}")


def surviving(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, steps) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The index pairs that no batch prunes, and their matches."""
    matches, seen = np.zeros(len(i), np.int32), 0
    for n, least in steps:
        for b in range(0, len(i), 1 << 16):
            s = slice(b, b + (1 << 16))
            matches[s] += (left[i[s], seen:n] == right[j[s], seen:n]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        i, j, matches, seen = i[keep], j[keep], matches[keep], n
    return i, j, matches


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _sign(key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for b in sliced(batches):
            classes, sizes, signs = [], [], []
            for t in b.column(2).to_pylist():
                words = normal_words(t)
                own = shingles(words, known)
                classes.append(class_key(words))
                sizes.append(len(own))
                signs.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(key_type), b.column(1), pa.array(classes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())],
                ["key", "rk", "cls", "n", "sig"])

    return run


def _banded(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    return sig[:, : bands * rows].reshape(-1, bands, rows)


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 16 * SLICE):
            sig = _banded(_signatures(b.column(1)), bands, rows).astype(np.uint64)
            x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M, sig.shape[:2]).copy()
            for k in range(rows):
                x = (x ^ sig[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(30)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64).ravel()), pa.array(np.tile(np.arange(bands, dtype=np.int16), len(sig))),
                 pa.array(np.repeat(b.column(0).to_numpy(), bands))], ["bucket", "band", "rid"])

    return run


def _prune(steps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 16 * SLICE):
            left, right = _signatures(b.column(2)), _signatures(b.column(3))
            rows = np.arange(len(left))
            i, _, _ = surviving(left, right, rows, rows, steps)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i))], ["a", "b"])

    return run


def _verify(part: int, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, recent = _WordHashes(), OrderedDict()

        def own(rid: int, text: str) -> np.ndarray:
            if rid not in recent:
                recent[rid] = shingles(normal_words(text), known)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[rid]

        for b in sliced(batches):
            linked = []
            for a, x, s, t in zip(*(c.to_pylist() for c in b.columns)):
                u, v = own(a, s), own(x, t)
                linked.append(similar(u, v, part, whole))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return run


def _same_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text is of the class that its hash was taken for."""
    for b in sliced(batches):
        keep = [class_key(normal_words(t)) == c for c, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(2).filter(pa.array(keep))], ["rid", "text"])


def _linked(rid: np.ndarray, root: np.ndarray, side: np.ndarray, sig: np.ndarray, texts: list, one: bool, band: int, cut: tuple[int, int], steps, part: int,
            whole: int, known: dict) -> list[tuple[int, int]]:
    """Links that join different components within one tile (``one``) or between its two sides."""
    rows = np.flatnonzero(side == 0)
    cols = rows if one else np.flatnonzero(side == 1)
    parts = []
    for k in range(0, len(rows), 128):
        r = rows[k: k + 128]
        i, j = np.nonzero(root[r][:, None] != root[cols])
        i, j = r[i], cols[j]
        if one:
            i, j = i[i < j], j[i < j]
        i, j, matches = surviving(sig, sig, i, j, steps)
        shared = (_banded(sig[i], *cut) == _banded(sig[j], *cut)).all(axis=2)
        here = shared.any(axis=1) & (shared.argmax(axis=1) == band)
        parts.append((i[here], j[here], matches[here]))
    if not parts:
        return []
    i, j, matches = (np.concatenate(v) for v in zip(*parts))
    order = np.argsort(-matches, kind="stable")
    sets: dict[int, np.ndarray] = {}
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    def own(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingles(normal_words(texts[k]), known)
        return sets[k]

    out = []
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        u, v = top(int(root[x])), top(int(root[y]))
        if u != v and similar(own(x), own(y), part, whole):
            up[u] = v
            out.append((int(rid[x]), int(rid[y])))
    return out


def _tile_links(cut: tuple[int, int], steps, part: int, whole: int):
    """Over rows sorted by tile pair: the links that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, group, held = _WordHashes(), None, [[] for _ in range(5)]

        def close() -> pa.RecordBatch:
            rid, root, side = (np.array(v, np.int64) for v in held[:3])
            sig = np.frombuffer(b"".join(held[3]), np.uint32).reshape(-1, HASHES)
            _, band, kind, t0, t1 = group
            links = _linked(rid, root, side, sig, held[4], kind == "r" and t0 == t1, band, cut, steps, part, whole, known)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

        for b in sliced(batches):
            for g, *row in zip(zip(*(c.to_pylist() for c in b.columns[:5])), *(c.to_pylist() for c in b.columns[5:])):
                if g != group:
                    if group is not None:
                        yield close()
                    group, held = g, [[] for _ in range(5)]
                for c, v in zip(held, row):
                    c.append(v)
        if group is not None:
            yield close()

    return run


def _tile_pairs(mixed: DataFrame, details: DataFrame, tile: int) -> DataFrame:
    """Rows (bucket, band, kind, t0, t1, rid, root, side, sig, text) of all tile
    pairs of ``mixed(bucket, band, rid, root)``. The bucket's largest component
    only meets the rest: members of one component are never compared."""
    sizes = mixed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("total"))
    sizes = sizes.select("bucket", "major", F.ceil(F.col("most") / tile).cast("int").alias("tm"),
                         F.ceil((F.col("total") - F.col("most")) / tile).cast("int").alias("tr"))
    m = stage(mixed.join(sizes, "bucket").withColumn("rest", F.col("root") != F.col("major")).withColumn(
        "own", F.pmod(F.xxhash64("rid"), F.when(F.col("rest"), F.col("tr")).otherwise(F.col("tm"))).cast("int")), "mixed-buckets")
    keys = ["bucket", "band", "kind", "t0", "t1"]

    def up(n: str):
        return F.sequence(F.lit(0), F.col(n) - 1)

    against = m.withColumn("o", F.explode(F.when(F.col("rest"), up("tm")).otherwise(up("tr")))).select(
        "bucket", "band", F.lit("m").alias("kind"), F.when(F.col("rest"), F.col("o")).otherwise(F.col("own")).alias("t0"),
        F.when(F.col("rest"), F.col("own")).otherwise(F.col("o")).alias("t1"), "rid", "root", F.col("rest").cast("int").alias("side"))
    among = m.where("rest").withColumn("o", F.explode(up("tr"))).select(
        "bucket", "band", F.lit("r").alias("kind"), F.least("own", "o").alias("t0"), F.greatest("own", "o").alias("t1"), "rid", "root",
        (F.col("own") > F.col("o")).cast("int").alias("side"))
    rows = against.unionAll(among).join(details, "rid").select(*keys, "rid", "root", "side", "sig", "text")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "rid")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", part: int = 85, whole: int = 100,
                    miss: float = 1e-6, tile: int = TILE) -> DataFrame:
    """One row per input row: key, n_shingles, component_id (smallest key
    reachable by links, itself included), kept (key is the component_id).

    Two texts are linked if ``whole * intersection >= part * union`` of their
    shingle sets (64-bit hashes). Bands follow from the threshold: a linked pair
    at the threshold itself shares none with a chance of at most ``miss`` (4e-7
    at 0.85, 8e-8 at 0.80), and is pruned with one of about ``miss``.

    Null, empty or blank text: no shingles, linked with nothing, its own
    component. Null keys count as rows but never as the smallest key; a
    component of null keys only keeps its rows. Rows of equal words, repeated
    rows included, are one class; a repeated key with two texts belongs to two
    classes. Empty table: empty result. Other columns are not looked at. Very
    long texts are hashed in blocks.
    """
    steps, cut = least_matches(part / whole, miss), banding(part / whole, miss)
    key_type = docs.schema[key].dataType
    rows = stage(
        docs.select(F.col(key), F.xxhash64(text).alias("rk"), F.col(text))
        .mapInArrow(_sign(to_arrow_type(key_type)), f"key {key_type.simpleString()}, rk long, cls binary, n long, sig binary"),
        "signatures",
    )
    reps = stage(
        rows.where("n > 0").groupBy("cls").agg(F.min("key").alias("first"), F.min("rk").alias("rk"), F.first("sig").alias("sig"))
        .withColumn("rid", F.monotonically_increasing_id()),
        "classes",
    )
    bands = stage(reps.select("rid", "sig").mapInArrow(_bands(*cut), "bucket long, band short, rid long"), "bands")
    shared = bands.groupBy("bucket").agg(F.min("rid").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    live = stage(bands.join(shared, "bucket").select("bucket", "band", "rid", "pivot", "size"), "buckets")
    candidates = stage(reps.join(live.select("rid").distinct(), "rid").select("rid", "cls", "rk", "sig"), "candidates")
    wanted = candidates.select("rid", "cls", F.col("rk").alias("r"))
    if candidates.count() <= MAX_BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.xxhash64(text).alias("rk"), F.col(text).alias("text")).join(wanted, F.col("rk") == F.col("r")).select("rid", "cls", "text")
    texts = stage(texts.mapInArrow(_same_text, "rid long, text string").groupBy("rid").agg(F.first("text").alias("text")), "candidate-texts")
    sigs = candidates.select("rid", "sig")

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("rid").alias("a"), F.col("text").alias("s"))
        right = texts.select(F.col("rid").alias("b"), F.col("text").alias("t"))
        joined = pairs.join(right, "b").join(left, "a").select("a", "b", "s", "t")
        return stage(joined.mapInArrow(_verify(part, whole), "a long, b long, linked boolean"), "verified")

    stars = live.where("rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b")).distinct()
    signed = stars.join(sigs.select(F.col("rid").alias("b"), F.col("sig").alias("v")), "b").join(
        sigs.select(F.col("rid").alias("a"), F.col("sig").alias("u")), "a").select("a", "b", "u", "v")
    tested = verified(signed.mapInArrow(_prune(steps), "a long, b long"))
    links = stage(tested.where("linked").select("a", "b"), "star-links")
    roots = components(links)
    members = live.where("size > 2").join(roots, F.col("rid") == F.col("node"), "left")
    members = members.select("bucket", "band", "rid", F.coalesce("root", "rid").alias("root"))
    several = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    mixed = stage(members.join(several.select("bucket"), "bucket"), "mixed-members")
    details = sigs.join(texts, "rid").join(mixed.select("rid").distinct(), "rid", "left_semi")
    more = stage(_tile_pairs(mixed, details, tile).mapInArrow(_tile_links(cut, steps, part, whole), "a long, b long"), "tile-links")
    roots = stage(components(links.unionAll(more)), "roots")
    placed = reps.select("cls", "first", "rid").join(roots, F.col("rid") == F.col("node"), "left")
    placed = placed.select("cls", "first", F.coalesce("root", "rid").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = placed.join(smallest, "root").select(F.col("cls").alias("c"), "component_id")
    some = rows.where("n > 0").select("key", "cls", "n").join(of_class, F.col("cls") == F.col("c")).select("key", "n", "component_id")
    none = rows.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    out = some.unionAll(none)
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept")
    )


def one_of_each(docs: DataFrame, *, row: Column | None = None, **options) -> DataFrame:
    """The documents with one row of each component, all columns kept: the
    first by ``row``, a unique name of the rows of a stored table
    (``common.file_row``); without it, ``docs`` is written once with a number
    per row, and the first in its order stays. Texts without words all stay."""
    rid = fresh(docs, "near_row")
    if row is None:
        rows = stage(docs.withColumn(rid, F.monotonically_increasing_id()), "near-documents")
    else:
        rows = docs.withColumn(rid, row)
    kept = near_duplicates(rows, key=rid, **options).where("kept").select(F.col(rid).alias("kept_row"))
    return rows.join(kept, F.col(rid) == F.col("kept_row"), "left_semi").drop(rid)
