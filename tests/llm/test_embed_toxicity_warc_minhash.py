"""Embedding near-duplicates (4), toxicity (6), WARC (7), MinHash near-duplicates (10)."""

import base64
import hashlib
import io
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from sitesift.llm import minhash, toxicity, warc
from sitesift.llm.common import scratch, scratch_of
from sitesift.llm.embed import close_pairs, near_duplicates, quantise
from sitesift.llm.graph import components


def closure(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closure({x for ab in links for x in ab}, links)
    assert got == {n: r for n, r in want.items() if n in got} and set(want) - set(got) <= {a for a, b in links if a == b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 24)) * rng.lognormal(size=(300, 24))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    q, scale, norm, rest = quantise(unit)
    approx = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale
    bound = norm[:, None] * rest + rest[:, None] * norm + rest[:, None] * rest
    assert (np.abs(approx - unit @ unit.T) <= bound + 1e-12).all()
    everything = np.arange(300)
    got = {(i, j) for a, b in close_pairs(unit, everything, everything, 0.5) for i, j in zip(a, b)}
    exact = unit @ unit.T
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if exact[i, j] >= 0.5}


@pytest.mark.parametrize("tile", [3, 1024])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(v) for v in centres[i % 6] + rng.normal(size=16) * 0.16], i % 2) for i in range(90)]
    rows += [(100 + i, rows[0][1], 0) for i in range(5)] + [(200, rows[0][1], 1), (201, rows[0][1], None), (202, None, 0), (203, [0.0] * 16, 0)]
    rows += [(204, [1.0, None] * 8, 0), (205, [float("nan")] * 16, 0), (206, [float("inf")] + [0.0] * 15, 0), (207, [], 0), (208, [1.0, 2.0], 0)]
    rows += [(None, rows[0][1], 0), (7, rows[7][1], 1), (7, rows[7][1], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, cid string, links int")
    got = near_duplicates(df, 0.93, tile=tile).collect()
    ok = [k for k, (_, v, y) in enumerate(rows) if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a in ok for b in ok if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1])
             and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]) >= 0.93]
    degree, root = Counter(x for ab in links for x in ab), closure(range(len(rows)), links)
    groups = defaultdict(list)
    for k, r in root.items():
        groups[r].append(rows[k][0])
    want = Counter()
    for k, (i, _, _) in enumerate(rows):
        c = min((x for x in groups[root[k]] if x is not None), default=None)
        want[i, degree[k], c, i == c] += 1
    have = Counter(map(tuple, got))
    assert not have - want and not want - have, (have - want, want - have)
    assert near_duplicates(df.limit(0), 0.93).count() == 0


def toxic_table(spark, n=400):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(3 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(["zorkel", "zorkelish", "vrump", "Vrump!", "zo.rk.el"]))
        rows.append((i, " ".join(text), "x", 0.5))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, features string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_learns_and_generalises(spark):
    docs, labels, truth = toxic_table(spark)
    rows = toxicity.score(docs, labels, trees=5).collect()
    held = [r for r in rows if r.held_out]
    assert 40 < len(held) < 130 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    kept = toxicity.without_toxic(docs, labels, trees=5)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.predicted}
    # held-out labels have no say
    other = spark.createDataFrame([(i, y if i not in {r.doc_id for r in held} else 1 - y) for i, y in truth.items()], "doc_id long, toxic int")
    assert sorted(toxicity.score(docs, other, trees=5).collect()) == sorted(rows)


def test_toxicity_without_labels_or_rows(spark, odd_docs, no_docs, odd_labels):
    rows = toxicity.score(odd_docs, odd_labels, trees=2).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.score(odd_docs, odd_labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(no_docs, odd_labels).count() == 0
    assert toxicity.without_toxic(odd_docs, odd_labels.limit(0)).count() == odd_docs.count()


def test_toxic_words_in_disguise():
    info = toxicity.WordInfo({"idiot": 3.0, "lowei": 2.0})
    for word, hidden in (("idiot", 0), ("IDIOT!!", 0), ("1d1ot", 16), ("i.d.i.o.t", 16), ("idiiiiot", 16), ("loweichen,", 0)):
        flags, weight, stem = info(word)
        assert flags & 1 and weight and stem and flags & 16 == hidden, word
    assert info("idol")[0] & 1 == 0


PAGES = ["", None, "<p>a</p>", "<p>a</p>", "café \U0001f600\r\n\r\nHTTP/1.1", "x" * 300_000, "<p>a</p>", "", "b\0c"]


def pages(spark):
    rows = [(i, f"http://h/{i}\r\nX: é", t, "clash") for i, t in enumerate(PAGES)] + [(None, None, "<p>a</p>", ""), (None, None, "only null", ""), (3, "again", "<p>a</p>", "")]
    rows += [(1000 + i, "u", f"<html>page {i} {'lorem ipsum ' * (i % 40)}</html>", "") for i in range(300)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least, monkeypatch):
    rows, df = pages(spark)
    folder = scratch(spark, "test-warc")
    written = warc.write_archives(df, folder, min_revisit_bytes=least)
    got = warc.read_archives(spark, folder, written).collect()
    top = defaultdict(list)
    for i, _, t, _ in rows:
        top[t or ""].append(i)
    want = Counter()
    for i, _, t, _ in rows:
        raw = (t or "").encode()
        best = max((x for x in top[t or ""] if x is not None), default=None)
        first = i == best or len(raw) < least
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else best] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.type, int(r.refers_to.split(":")[2]) if r.refers_to else None) for r in got) == want
    assert {r.uri for r in got if r.page_id == 5} == {"http://h/5%0D%0AX: é"}
    assert warc.read_archives(spark, scratch(spark, "none"), warc.write_archives(df.limit(0), scratch(spark, "none"))).count() == 0


def archive(records, dictionary=b""):
    out = struct.pack("<II", warc.DICTIONARY_FRAME, len(dictionary)) + dictionary
    return io.BytesIO(out + b"".join(map(zstandard.ZstdCompressor().compress, records)))


def test_reader_refuses_what_is_broken():
    good = warc.build_record(1, "u", "2020-01-01T00:00:00Z", warc.base32_sha1(b"abc"), 3, b"abc", None)
    assert [r["payload_bytes"] for r in warc.read_archive(archive([good, good]))] == [3, 3]
    packed = zstandard.ZstdCompressor().compress(b"")
    assert len(list(warc.read_archive(archive([good], packed)))) == 1
    bad = [good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X"), good.replace(b"abc", b"abd"), good[:-1], good + b"x",
           good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"response\r\n", b"gossip\r\n", 1), b"", good.replace(b": 1970", b"")[:20]]
    for raw in bad:
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(archive([raw])))
    whole = archive([good]).getvalue()
    for cut in (b"", whole[:4], b"\0" * 20, whole[:-3], struct.pack("<II", warc.DICTIONARY_FRAME, 99)):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(io.BytesIO(cut)))


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expect(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = closure(range(len(rows)), links)
    groups = defaultdict(list)
    for k, r in root.items():
        groups[r].append(rows[k][0])
    out = Counter()
    for k, (i, _) in enumerate(rows):
        c = min((x for x in groups[root[k]] if x is not None), default=None)
        out[i, len(sets[k]), c, i == c] += 1
    return out


def near_copies(n=60, words=150):
    """A base text and copies that each change some words: pairs of copies lie on both sides of the threshold."""
    rng = random.Random(8)
    rows = []
    for g in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for i in range(n):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(words)] = f"x{rng.randrange(9999)}"
            rows.append((1000 * (3 - g) + n - i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("tile", [8, 1024])
def test_near_duplicates_equal_brute_force(spark, tile):
    rows = near_copies()
    rows += [(1, "One two"), (2, "one  TWO"), (3, "one two three"), (4, None), (5, ""), (None, "one two"), (None, "lone null"), (6, "ONE TWÉ"), (6, "one two")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, cls string, n int")
    assert Counter(map(tuple, minhash.near_duplicates(df, tile=tile).collect())) == expect(rows)


def test_refused_pivots_do_not_hide_links(spark, monkeypatch):
    """The smallest of a bucket is far from all others: only tiles can link those."""
    base = [f"w{i}" for i in range(200)]
    far = [f"v{i}" if i % 24 == 0 else w for i, w in enumerate(base)]  # about 0.65 to base
    rows = [(1, " ".join(far))] + [(k, " ".join(w if i != 190 + k else f"c{k}" for i, w in enumerate(base))) for k in range(2, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")
    monkeypatch.setattr(minhash, "least_matches", lambda t, miss: [(minhash.HASHES, 0)])  # prune nothing: every candidate is verified
    assert Counter(map(tuple, minhash.near_duplicates(df, tile=2).collect())) == expect(rows)


def test_posterior_bound():
    steps = minhash.least_matches(0.85, 1e-6)
    assert [n for n, _ in steps] == [25, 50, 75, 100, 125]
    for n, m in steps:  # the posterior tail by numerical integration
        x = np.linspace(0, 1, 200_001)
        for hits, low in ((m - 1, True), (m, False)):
            if hits >= 0:
                density = x**hits * (1 - x) ** (n - hits)
                assert (density[x >= 0.85].sum() / density.sum() < 1e-6 * 1.01) == low


def test_pipeline_stage_links_from_four_fifths(spark):
    """Pairs of two changed words at 0.79, 0.80 exactly, and 0.81 to 0.84, against brute force."""
    rng, rows = random.Random(13), []
    for n in (85, 90, 95, 100, 105, 110, 115):  # shingles; two lone changes leave (n - 10) / (n + 10)
        for g in range(12):
            base = [f"w{n}x{g}x{i}" for i in range(n + 4)]
            copy = [f"c{w}" if i in (20 + g, 50 + g) else w for i, w in enumerate(base)]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    rng.shuffle(rows)
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(i, i + 1) for i in range(0, len(rows), 2) if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])]
    assert len(links) == 72
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()}
    root = closure(range(len(rows)), links)
    assert Counter(root[i] for i in kept) == Counter(set(root.values()))


def test_bands_follow_the_threshold():
    assert minhash.banding(0.85, 1e-6) == (25, 5) and minhash.banding(0.80, 1e-6) == (31, 4)
    for t in (0.3, 0.5, 0.7, 0.8, 0.85, 0.9, 0.99):
        bands, rows = minhash.banding(t, 1e-6)
        assert bands * rows <= minhash.HASHES and (1 - t**rows) ** bands <= 1e-6
    with pytest.raises(ValueError):
        minhash.banding(0.01, 1e-6)


def test_near_duplicates_on_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter(map(tuple, minhash.near_duplicates(odd_docs).collect())) == expect(rows)
    assert minhash.near_duplicates(no_docs).count() == 0
    kept = minhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({frozenset(shingle_set(t)) for _, t in rows if shingle_set(t)}) + sum(not shingle_set(t) for _, t in rows)


def test_signatures_estimate_similarity():
    known = minhash._WordHashes()
    rng = random.Random(9)
    words = [f"w{i}".encode() for i in range(3000)]
    a, b = minhash.shingles(words, known), minhash.shingles(words[:2000] + [f"z{rng.random()}".encode() for _ in range(1000)], known)
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - exact) < 0.15
    assert len(minhash.shingles([], known)) == 0 and len(minhash.shingles([b"a"], known)) == 1


def plain_features(text, lexicon):
    """The features word by word and pattern by pattern."""
    info, words = toxicity.WordInfo(lexicon), text.split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    n, chars, rows = len(words), len(text), []
    for w in words:
        base, inner = toxicity.plain(w), re.sub(r"^\W+|\W+$", "", w)
        open_stem = info.find(base)
        mixed = bool(re.search(r"[^\W\d_]", w) and re.search(r"[\d@$!|*_~+]", inner))
        masked = mixed or re.search(r"[.\-_*'~+]", inner) or re.search(r"[!?]{2,}|(\w)\1\1\1", w)
        stem = open_stem if open_stem is not None else info.find(toxicity.unmasked(w)) if masked else None
        rows.append((stem, base in toxicity.SECOND_PERSON, len(inner) > 1 and inner.isupper(), mixed, stem is not None and open_stem is None))
    hits, you = [i for i, r in enumerate(rows) if r[0]], [i for i, r in enumerate(rows) if r[1]]
    dist = [min(abs(h - y) for y in you) for h in hits] if you else []
    return [
        100 * len(hits) / n, math.log1p(len(hits)), 100 * sum(lexicon[rows[h][0]] for h in hits) / n, len({rows[h][0] for h in hits}),
        100 * sum(r[4] for r in rows) / n, max((sum(h <= x < h + 50 for x in hits) for h in hits), default=0),
        sum(d <= 5 for d in dist) / len(dist) if dist else 0, 100 * len(you) / n, 1 / (1 + min(dist)) if dist else 0,
        sum(r[2] for r in rows) / n, len(re.findall(r"[A-Z\xc0-\xd6\xd8-\xde]", text)) / chars, 100 * len(re.findall(r"[!?]", text)) / chars,
        100 * len(re.findall(r"[^\w\s]", text)) / chars, 100 * len(list(re.finditer(r"[!?]{2,}|(\w)\1\1\1", text))) / chars,
        sum(r[3] for r in rows) / n, math.log1p(n),
    ]


LEXICON = {"idiot": 3.0, "dumm": 2.5, "stup": 2.0, "trash": 1.75}


def test_features_equal_a_plain_restatement():
    rng = random.Random(8)
    some = ["you", "Du", "IDIOT", "id10t", "i.d.i.o.t", "stupid!!", "trash?!", "fine", "ÄRGER", "été", "dummkopf", "a", "über—all", "日本、語", "「x」", "aaaa",
            "nooooo", "\U0001f600", "don't", "s-t-u-p-i-d", "x1", "!?", "...", "¿qué?", "WORD,", "ǅ"]
    info = toxicity.WordInfo(LEXICON)
    for _ in range(400):
        text = "".join(rng.choice(some) + rng.choice([" ", "  ", "\n", "　"]) for _ in range(rng.randint(0, 90)))
        assert toxicity.features(text, info) == pytest.approx(plain_features(text, LEXICON), abs=1e-9), text


def test_lexicon_equals_a_plain_restatement(spark):
    docs, labels, truth = toxic_table(spark)
    labelled = docs.join(labels, "doc_id").select("text", "toxic")
    rows = [(r.text or "", r.toxic) for r in labelled.collect()]
    n, y = len(rows), sum(t for _, t in rows)
    seen = {}
    for text, t in rows:
        for s in {s for w in text.split() for s in toxicity.stems_of(toxicity.plain(w)) if s}:
            a = seen.setdefault(s, [0, 0])
            a[0] += 1
            a[1] += t
    want = {}
    for s, (m, k) in seen.items():
        part = lambda c, share: c * math.log(c / m / share) if c else 0.0
        odds = math.log((k + 0.5) / (m - k + 0.5) * (n - y) / y)
        if 2 * (part(k, y / n) + part(m - k, 1 - y / n)) >= toxicity.MIN_RATIO and odds > 1.5:
            want[s] = odds
    assert want and toxicity.learn_lexicon(labelled) == pytest.approx(want)


def test_calibration_equals_pooled_neighbours(spark):
    """What the model maps raw scores to is the isotonic fit of fold 4, equal scores first pooled."""
    docs, labels, _ = toxic_table(spark)
    model = toxicity.fit(docs, labels, trees=5)
    vector = toxicity.with_features(docs.join(labels, "doc_id").where(toxicity.fold_of("doc_id") == 4), "text", model.lexicon, "v")
    raw = [(r.p, r.toxic) for r in model.raw(vector.select("toxic", "v"), "v", "p").collect()]
    blocks = []  # score, sum, weight
    for p in sorted({p for p, _ in raw}):
        ys = [y for q, y in raw if q == p]
        blocks.append([[p], float(sum(ys)), len(ys)])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    want = {p: total / weight for ps, total, weight in blocks for p in ps}
    got = {p: model.calibration.predict(p) for p in want}
    assert len(want) > 1 and got == pytest.approx(want)


def test_at_most_the_bound_of_labels(spark):
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs = labels.select("doc_id", F.concat(F.lit("w"), F.col("toxic").cast("string")).alias("text"))
    with scratch_of() as paths:
        toxicity.fit(docs, labels, max_labels=500, trees=1)
    kept = spark.read.parquet(next(p for p in paths if "/labels-" in p))
    assert kept.count() == 500
    smallest = labels.where(toxicity.fold_of("doc_id") != 0).orderBy(F.xxhash64("doc_id")).limit(500)
    assert {r.label_key for r in kept.collect()} == {r.doc_id for r in smallest.collect()}


def test_tasks_hold_few_texts_and_words_at_a_time():
    import pyarrow as pa

    from sitesift.llm import toxicity
    from sitesift.llm.common import SLICE

    n = 3 * SLICE + 5
    texts = [None if i % 7 == 0 else f"w{i} one two three four five six" for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], ["key", "rk", "text"])
    out = list(minhash._sign(pa.int64())(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= SLICE
    got = pa.Table.from_batches(out)
    assert got["key"].to_pylist() == list(range(n))
    assert got["n"].to_pylist() == [0 if t is None else 3 for t in texts]
    assert max(minhash.TASK_WORDS, toxicity.TASK_WORDS) <= 100_000  # a remembered word is some 180 bytes of a worker


def test_tasks_remember_no_long_words(spark):
    from sitesift.llm import toxicity
    from sitesift.llm.common import KEPT_CHARS

    long = "y" * (KEPT_CHARS + 1)
    info, known = toxicity.WordInfo({"yyyy": 3.0}), minhash._WordHashes()
    assert info(long) == info(long) and info(long)[2] == "yyyy" and long not in info
    assert known[long.encode()] == known[long.encode()] and not known
    assert info("yyyyy")[2] == "yyyy" and "yyyyy" in info
    rows = [(f"{long} word{i} {'vile' if i % 2 else 'kind'} {long}", i % 2) for i in range(200)]
    assert set(toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))) == {"vile"}
