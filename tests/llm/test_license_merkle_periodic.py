"""License scan, Merkle manifest and periodic runs against plain restatements."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from .conftest import odd_rows
from sitesift.llm.license_scan import Template, license_spans, word_list
from sitesift.llm.merkle import folded_root, manifest, proof_digest
from sitesift.llm.periodic import periodic_runs, piece_runs, runs_of, without_repeats
from sitesift.llm.q11_license import PHRASES, TEMPLATES

# ---- license scan

WORDING = Template("long", " ".join(f"w{i}" for i in range(30)), 0.2)
SELF = Template("self", "a b c a b c a b c d e f g h i j k l", 0.2)
SOME = (*PHRASES, WORDING, SELF)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
    return row


def plain_spans(text, templates):
    """All stretches of all lengths; of each series of ends in reach the first best, its shortest stretch."""
    words, out = word_list(text), []
    for k, t in enumerate(templates):
        target, most = t.words, t.edits
        best = {}
        for start in range(len(words) + 1):
            for length, d in enumerate(plain_distance(target, words[start:start + len(target) + most])):
                if d <= most:
                    best[start + length] = min(best.get(start + length, (d, length)), (d, length))
        ends = sorted(best)
        series = [[e] for e in ends[:1]]
        for e in ends[1:]:
            series[-1].append(e) if most and e == series[-1][-1] + 1 else series.append([e])
        for s in series:
            d, end = min((best[e][0], e) for e in s)
            out.append((k, t.label, end - best[end][1], best[end][1], d))
    return sorted(out, key=lambda r: (r[2], r[0]))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(max(1, len(words)))
        if kind == 0 and words:
            words[at] = "x"
        elif kind == 1:
            words.insert(at, "y")
        elif words:
            del words[at]
    return words


@pytest.fixture(scope="module")
def licensed():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        text = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            text += edited(rng, rng.choice(SOME).words, rng.randint(0, 7)) + [rng.choice("abc z".split()) for _ in range(rng.randint(0, 4))]
        rows.append((i, " ".join(text).replace("mit", rng.choice(["MIT", "mit,", "Mit"]))))
    return rows + [(200, "under the MIT-License under the mit license CC BY-NC cc by nc"), (201, "under the mit licenseé"), (202, "mit license")]


def test_license_spans_equal_brute_force(spark, licensed):
    got = license_spans(spark.createDataFrame(licensed, "doc_id long, text string"), SOME).collect()
    assert len(got) == len(licensed)
    texts, seen = dict(licensed), 0
    for r in got:
        want = plain_spans(texts[r.doc_id], SOME)
        assert [(s.template, s.label, s.start, s.length, s.edits) for s in r.spans] == want, texts[r.doc_id]
        assert r.n_words == len(word_list(texts[r.doc_id]))
        seen += sum(w[4] > 0 for w in want)
    assert seen > 20  # edited copies too


def test_license_spans_of_odd_rows(spark, odd_docs, no_docs):
    got = sorted(((r.doc_id, r.n_words, len(r.spans)) for r in license_spans(odd_docs, TEMPLATES).collect()), key=repr)
    assert got == sorted(((i, len(word_list(t)), 0) for i, t, *_ in odd_rows()), key=repr)
    assert license_spans(no_docs, TEMPLATES).count() == 0
    with pytest.raises(ValueError):
        license_spans(odd_docs, [Template("x", "two words")])


def test_license_notices_are_found_with_edits(spark):
    texts = [(i, "intro words " + " ".join(edited(random.Random(i), t.words, t.edits)) + " end") for i, t in enumerate(TEMPLATES)]
    got = license_spans(spark.createDataFrame(texts, "doc_id long, text string"), TEMPLATES).collect()
    assert all(TEMPLATES[r.doc_id].label in [s.label for s in r.spans] for r in got)


# ---- Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows, fan):
    """rows (key, source, text) -> sorted (key, leaf, siblings joined, subroot, root)."""
    groups = {}
    for k, s, t in rows:
        groups.setdefault(s, []).append((k is not None, k or 0, leaf_of(k, t), k))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))

    def tree(digests):
        paths, at = [""] * len(digests), list(range(len(digests)))
        while len(digests) > 1:
            runs = [digests[i:i + fan] for i in range(0, len(digests), fan)]
            for i, a in enumerate(at):
                paths[i] += "".join(d for j, d in enumerate(runs[a // fan]) if j != a % fan)
            at, digests = [a // fan for a in at], [sha(*r) for r in runs]
        return digests[0], paths

    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, above = tree([trees[s][0] for s in order])
    return sorted(
        ((x[3], x[2], p + above[i], trees[s][0], root) for i, s in enumerate(order) for x, p in zip(sorted(groups[s]), trees[s][1])), key=repr
    )


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_manifest_equals_plain_trees(spark, fan):
    sizes = {"a": 1, "B": 2, None: 16, "": 17, "é": 33, "big": 300}
    rows = [(i, s, f"t{i}{s}") for s, n in sizes.items() for i in range(n)] + [(3, "a", None), (3, "a", None), (None, "big", "x")]
    m = manifest(spark.createDataFrame(rows, "doc_id long, source string, text string"), ["doc_id", "text"], fan_out=fan,
                 also={"other": F.upper("text")})
    got = m.select("doc_id", "leaf", "path", "subroot", "root", proof_digest(F.col("path")).alias("proof"),
                   folded_root(F.col("leaf"), F.col("path")).alias("folded"),
                   folded_root(F.sha2(F.concat("leaf", F.lit("!")), 256), F.col("path")).alias("bad")).collect()
    joined = sorted(((r.doc_id, r.leaf, "".join(p.left + p.right for p in r.path), r.subroot, r.root) for r in got), key=repr)
    assert joined == plain_manifest(rows, fan)
    assert all(r.folded == r.root != r.bad and r.proof == sha(*(p.left + p.right for p in r.path)) for r in got)


def test_manifest_of_many_sources_one_row_and_none(spark, no_docs):
    rows = [(i, f"s{i}", "x") for i in range(40)]
    m = manifest(spark.createDataFrame(rows, "doc_id long, source string, text string"), ["doc_id", "text"])
    assert sorted(((r.doc_id, r.leaf, "".join(p.left + p.right for p in r.path), r.subroot, r.root) for r in m.collect()), key=repr) == plain_manifest(rows, 16)
    (one,) = manifest(spark.createDataFrame(rows[:1], "doc_id long, source string, text string"), ["doc_id", "text"]).collect()
    assert one.path == [] and one.leaf == one.subroot == one.root
    assert manifest(no_docs, ["doc_id", "text"]).count() == 0


def test_manifest_of_odd_rows(spark, odd_docs):
    got = manifest(odd_docs, ["doc_id", "text"]).select("doc_id", "leaf", "path", "subroot", "root").collect()
    rows = [(i, s, t) for i, t, _, s in odd_rows()]
    assert sorted(((r.doc_id, r.leaf, "".join(p.left + p.right for p in r.path), r.subroot, r.root) for r in got), key=repr) == plain_manifest(rows, 16)


# ---- periodic runs


def plain_runs(words, least, exponent):
    out = {}
    for q in range(1, len(words) // exponent + 1):
        j = q
        while j < len(words):
            start = j
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j - start + q >= max(least, exponent * q):
                out.setdefault((start - q, j - start + q), q)
            j += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, k = rng.randint(0, 150), rng.randint(1, 4)
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if n:
            a, p = rng.randrange(n), rng.randint(1, 8)
            for i in range(a, min(n, a + rng.randint(0, 60))):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 3), (8, 3), (4, 4), (6, 5)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least * 10 + exponent)
    for _ in range(400):
        words = some_words(rng)
        want = plain_runs(words, least, exponent)
        assert runs_of(words, least, exponent) == want
        assert sorted(piece_runs(words, least, exponent)) == sorted(want)


def test_long_texts_in_about_linear_steps():
    for words in ([0] * 30_000, list(np.arange(15_000) % 3_000) * 2, [i % 7 for i in range(30_000)]):
        assert len(runs_of(words)) == 1


def test_periodic_runs_of_rows(spark, odd_docs, no_docs):
    rng = random.Random(9)
    rows = [(i, " \t".join(f"w{c}" for c in some_words(rng)) + " \x1c") for i in range(80)]
    docs = odd_docs.select("doc_id", "text", "key", "n").unionByName(
        spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("x").alias("key"), F.lit("x").alias("n")))
    want = []
    for i, t in [(r[0], r[1]) for r in odd_rows()] + rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = plain_runs(words, 6, 4)
        kept = [w for j, w in enumerate(words) if not any(s + q <= j < s + n for s, n, q in runs)]
        assert without_repeats(words, runs) == kept
        want.append((i, len(words), runs, " ".join(kept)))
    got = [(r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(len(w[2]) for w in want) > 50
    assert periodic_runs(no_docs).count() == 0
