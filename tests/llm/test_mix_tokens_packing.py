"""Mixing (1), token counts (3), packing (8)."""

import os
import random
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from oracle_harness import compare
from sitesift.llm import tokens
from sitesift.llm.common import WORD, file_row, free, scratch_of, stage
from sitesift.llm.minhash import one_of_each
from sitesift.llm.mix import capped_targets, mix, mixed_documents, schedule_segments, training_order
from sitesift.llm.packing import CACHE_WORDS, ByteTokenizer, Plan, pack
from sitesift.llm.q01_mix import curriculum
from sitesift.llm.queries import oracle_sql, queries
from sitesift.llm.tokens import PreTokenizer, token_counts

import re

BYTES, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = [
    "it's <|endoftext|>x<|startoftext|><|endoftext|>", "\u03a3\u0391\u03a3 '\u0391\u03a3 'S we'LL don't 12345 e\u0301a \u0301",
    "x\u00a0y\u0085z\x1cq\u3000 w", "\ufb01 \u00bd \u2167 \u4e2d\u6587 \u0440\u0443\u0441 \u0130stanbul", "!!!???...", "\0 \0\x01",
    "<|endoftext|", "x<|ENDOFTEXT|>y", "'''ss'd'dog", " lead", "trail ", "two  gaps", "a\n\nb \n c\r\n", "\ud7ff \U0001d518 \U0001f44d", "\n", " ",
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_capped_targets_reshare():
    # 1 would get 60 of 100 but stops at 30; the rest share 70 by 1:1, of which one stops at 15
    assert capped_targets([10, 5, 85], [3, 1, 1], 100, 3) == [30.0, 15.0, 55.0]
    assert capped_targets([0, 10], [5, 1], 10, 3) == [0.0, 10.0]
    assert capped_targets([], [], 0, 3) == []


def test_schedules_are_checked():
    with pytest.raises(ValueError):
        schedule_segments([(0, 1), (0.5, 1)])
    with pytest.raises(ValueError):
        schedule_segments([(0, 0), (1, 0)])


def test_mix_meets_targets_and_positions(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 50), f"s{i % 4}" if i % 5 else None) for i in range(400)]
    m = training_order(mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), curriculum)).collect()
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in m:
        assert r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.placements)
        assert [p.position for p in r.placements] == sorted(p.position for p in r.placements)
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(size, key=lambda s: (s is None, s))
    assert [target[s] for s in names] == pytest.approx(capped_targets([size[s] for s in names], [1, 2, 3, 1, 2], sum(size.values()), 3))
    assert all(taken[s] == int(target[s] + 0.5) == sum(r.taken for r in m if r.source == s) for s in names)
    first = [r.position for r in m if r.position is not None]
    assert first == sorted(first) and 0 <= min(first) and max(first) <= 1
    # the demand at a copy's position is what its source has queued before it: integrate the schedule numerically
    for s, knots in zip(names, map(curriculum, range(5), names)):
        t = np.linspace(0, 1, 2001)
        w = np.interp(t, *zip(*knots))
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))])
        copies = sorted((p.position, p.words) for r in m if r.source == s for p in r.placements)
        queued = 0
        for position, n in copies:
            assert np.interp(position, t, area / area[-1]) * taken[s] == pytest.approx(queued, abs=1)
            queued += n


def test_mix_on_odd_rows(odd_docs, no_docs):
    a, b = (sorted(map(str, mix(odd_docs, curriculum).collect())) for _ in range(2))
    assert a == b and len(a) == odd_docs.count()  # reruns agree
    assert mix(no_docs, curriculum).count() == 0
    docs = mixed_documents(odd_docs, curriculum)
    assert docs.columns == odd_docs.columns
    got = sum(len(words(r.text)) for r in docs.collect())
    assert got == sum(r.taken for r in mix(odd_docs, curriculum).collect())
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    assert mixed_documents(no_docs, curriculum).count() == 0
    assert WORD == r"[^\x20\x09-\x0D]+"


SCHEMA = "doc_id long, text string, source string, n_chars long"
NO_WORDS = [(2, "", "y", 0), (3, None, "y", None), (4, " \n ", "z", 3), (5, None, None, None)]


@pytest.mark.parametrize("rows", [[(1, "a b c", "x", 5)] + NO_WORDS, NO_WORDS])
@pytest.mark.parametrize("whole", [True, False])
def test_sources_without_words(spark, tmp_path, rows, whole):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.size, r.source_size, r.target, r.taken, r.position, len(r.placements)) for r in mix(docs, curriculum).collect()}
    assert len(got) == len(rows)
    assert all(got[k] == (0, 0, 0.0, 0, None, 0) for k in (2, 3, 4, 5))
    mixed = [r.doc_id for r in mixed_documents(docs, curriculum, whole=whole).collect()]
    assert mixed == [1] * len(mixed) and bool(mixed) == (rows[0][0] == 1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    query = queries()["op1_curriculum_mix"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    r = compare(query, con, oracle_sql()["op1_curriculum_mix"])
    assert r["cols_match"] and r["values_match"], r["first_diff"]


def test_rows_named_by_their_place(spark, tmp_path, odd_docs):
    """Stored tables need no copy of their texts; the result is that of any other frame."""
    odd_docs.repartition(3).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    row = file_row(stored)
    assert stored.select(row).distinct().count() == stored.count() == odd_docs.count()
    assert file_row(odd_docs) is None
    for whole in (True, False):
        copied = Counter(map(tuple, mixed_documents(stored, curriculum, whole=whole).collect()))
        assert copied == Counter(map(tuple, mixed_documents(stored, curriculum, whole=whole, row=row).collect()))
    kept = [Counter((words(r.text) and tuple(words(r.text))) or () for r in one_of_each(stored, part=80, row=x).collect()) for x in (row, None)]
    assert {k: v for k, v in kept[0].items() if k} == {k: v for k, v in kept[1].items() if k} and kept[0][()] == kept[1][()]


def test_free_deletes_what_was_recorded(spark, tmp_path):
    with scratch_of() as tables:
        a = stage(spark.range(3), "freed")
    b = stage(spark.range(4), "kept")
    assert len(tables) == 1 and a.count() == 3
    free(spark, tables)
    assert not os.path.exists(tables[0].removeprefix("file:")) and b.count() == 4


def test_mixed_copies_stay_whole(spark, odd_docs):
    """One source of one long document at 5/8 and one at 3/8 of its words, and the odd rows."""
    texts = {1: " ".join(f"a{i}" for i in range(400)), 2: " ".join(f"b{i}" for i in range(400))}
    df = spark.createDataFrame([(k, t, "x" if k == 1 else "y", len(t)) for k, t in texts.items()], "doc_id long, text string, source string, n_chars long")
    by = {"x": [(0, 5.0), (1, 5.0)], "y": [(0, 11.0), (1, 11.0)]}  # of 800 words: 250 and 550
    got = mixed_documents(df, lambda i, s: by[s], whole=True).collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got) == Counter({(k, texts[k], len(texts[k])): 1 for k in (1, 2)})
    got = mixed_documents(odd_docs, curriculum, whole=True).collect()
    assert {(r.doc_id, r.text, r.n_chars) for r in got} <= {(r.doc_id, r.text, r.n_chars) for r in odd_docs.collect()}
    have, largest, target = Counter(), Counter(), {}
    for r in got:
        have[r.source] += len(words(r.text))
    for r in mix(odd_docs, curriculum).collect():
        largest[r.source], target[r.source] = max(largest[r.source], r.size), r.target
    assert all(abs(have[s] - t) <= largest[s] / 2 + 1 for s, t in target.items())


def test_pre_tokens_equal_the_library():
    split, whole = PreTokenizer(WORDS), Tokenizer.from_file(WORDS)
    for t in ODD_TEXTS:
        parts = [p for w in split.words(t) for p in split(w)]
        assert sum(split.pieces(parts)) == len(whole.encode(t, add_special_tokens=False).ids), t


@pytest.mark.parametrize("head", [0, 5, 1 << 17])
def test_token_counts_equal_the_library(spark, odd_docs, head):
    whole = Tokenizer.from_file(WORDS)
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, head_size=head).collect()
    want = Counter((i, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_token_counts_of_nothing(odd_docs, no_docs):
    assert token_counts(no_docs, WORDS).count() == 0
    assert token_counts(odd_docs, WORDS).columns == ["doc_id", "n_bytes", "n_tokens"]


def test_pieces_are_counted_without_threads():
    """A Python worker keeps to its core: threads for all cores of the machine took memory in each worker."""
    code = (
        "import os, sys; from sitesift.llm.tokens import PreTokenizer; split = PreTokenizer(sys.argv[1])\n"
        "before = len(os.listdir('/proc/self/task')); split.pieces([f'word{i}' for i in range(5000)])\n"
        "print(len(os.listdir('/proc/self/task')) - before)"
    )
    env = os.environ | {"RAYON_NUM_THREADS": "4", "TOKENIZERS_PARALLELISM": "true", "PYTHONPATH": os.pathsep.join(sys.path)}
    assert subprocess.run([sys.executable, "-c", code, WORDS], env=env, capture_output=True, text=True, check=True).stdout == "0\n"


def test_token_counts_of_small_holdings(spark, monkeypatch):
    """What a task holds is bounded by words and by characters; counts handed on early are the same."""
    whole = Tokenizer.from_file(WORDS)
    rows = [(i, t) for i, t in enumerate([*ODD_TEXTS, "z\u00e9bra" * 300 + " a z\u00e9bra", "many words " * 900, None])]
    want = Counter((i, len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for words_held, chars_held in ((3, 1 << 25), (1000, 20)):
        monkeypatch.setattr(tokens, "TASK_WORDS", words_held)
        monkeypatch.setattr(tokens, "TASK_CHARS", chars_held)
        monkeypatch.setattr(tokens, "KEPT_CHARS", 4)
        monkeypatch.setattr(tokens, "TASK_ROWS", 5)
        assert Counter(map(tuple, token_counts(docs, WORDS, head_size=5).collect())) == want


def test_byte_ids_equal_the_library():
    fast, whole = ByteTokenizer(BYTES, RANKS), Tokenizer.from_file(BYTES)
    for t in [*ODD_TEXTS, "The Quick, brown\nfox's 12 caf\u00e9s \u00e0 la carte.\nEnd", "caf\u00e9<|endoftext|>", "plain words of all kinds " * 200 + "\u4e2d"]:
        assert np.frombuffer(fast(t), np.uint16).tolist() == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("weights", [None, [1, 1, 1, 0], [5, 0, 1, 3]])
def test_plan_places_every_token_once_and_keeps_the_mixture(weights):
    totals, window, sequence = [5000, 900, 3, 2111], 256, 64
    plan = Plan(totals, weights, window, sequence)
    seen = {}
    for j, total in enumerate(totals):
        at = 0
        while at < total:  # runs of odd lengths, as documents have them
            n = min(total - at, 37 + at % 11)
            for start, length, seq, offset in plan.pieces(j, at, n):
                for k in range(length):
                    assert seen.setdefault((seq, offset + k), (j, at + start + k)) == (j, at + start + k)
            at += n
    assert len(seen) == sum(totals)
    lengths = Counter(s for s, _ in seen)
    assert all(n == sequence or n & (n - 1) == 0 for n in lengths.values())
    assert all((s, o) in seen for s, n in lengths.items() for o in range(n))
    if weights is None:  # round by round, each queue gets its quantum and carries the fraction
        stream = [seen[k][0] for k in sorted(seen)]
        at, rounds = 0, 0
        while at < len(stream):
            rounds += 1
            due = min(rounds * window, sum(totals))
            sent = [n * due // sum(totals) for n in totals]
            assert [stream[:sum(sent)].count(j) for j in range(4)] == sent
            at = sum(sent) if due < sum(totals) else len(stream)


def test_pack_round_trip(spark, odd_docs, no_docs):
    whole = Tokenizer.from_file(BYTES)
    rows = odd_docs.select("doc_id", "text", "source").collect()
    pieces = pack(odd_docs, BYTES, ranks=RANKS, sequence=64, window_sequences=4).collect()
    want = Counter((r.doc_id, r.source, tuple(whole.encode(r.text or "", add_special_tokens=False).ids + [0])) for r in rows)
    parts = defaultdict(list)
    for p in pieces:
        parts[p.doc_id, p.source, p.doc_tokens].append((p.start, np.frombuffer(p.ids, "<u4")))
        assert len(p.ids) == 4 * p.length
    assert sum(p.length for p in pieces) == sum(len(k[2]) * n for k, n in want.items())
    for (i, s, n), own in parts.items():
        copies = sum(c for (a, b, ids), c in want.items() if (a, b, len(ids)) == (i, s, n))
        if copies == 1:
            joined = tuple(np.concatenate([x for _, x in sorted(own, key=lambda x: x[0])]).tolist())
            assert want[i, s, joined] == 1
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    assert pack(no_docs, BYTES, ranks=RANKS).count() == 0
    assert zlib.crc32(b"") == 0


def test_packing_holds_few_rows_and_words_at_a_time(monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    from sitesift.llm import packing
    from sitesift.llm.common import KEPT_CHARS, SLICE

    class Task:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Task))
    n, long = 3 * SLICE + 5, "x" * (KEPT_CHARS + 1)
    texts = [None if i % 7 == 0 else f"w{i} one two {long} {long}" for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["ab"[i % 2] for i in range(n)]), pa.array(texts)], ["key", "source", "text"])
    out = list(packing._encode(BYTES, RANKS, 0, pa.int64())(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= SLICE
    got, whole = pa.Table.from_batches(out), Tokenizer.from_file(BYTES)
    want = [whole.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert [np.frombuffer(x, np.uint16).tolist() for x in got["ids"].to_pylist()] == want
    assert got["n"].to_pylist() == [len(w) for w in want] and got["part"].to_pylist() == [3] * n
    assert got["queued"].to_pylist() == [sum(map(len, want[i % 2: i: 2])) for i in range(n)]
    words = packing.byte_tokenizer(BYTES, RANKS).words
    assert "one" in words and long not in words
    monkeypatch.setattr(packing, "CACHE_WORDS", 10)
    assert all(words[w] == words.pack(" " + w) for w in (f"v{i}" for i in range(30))) and len(words) <= 10
    assert CACHE_WORDS <= 250_000

    totals = [sum(map(len, want[j::2])) for j in range(2)]
    at = pa.RecordBatch.from_arrays(
        [got["key"].combine_chunks(), got["source"].combine_chunks(), got["n"].combine_chunks(), got["ids"].combine_chunks(), got["queued"].combine_chunks()],
        ["key", "source", "n", "ids", "at"])
    pieces = list(packing._cut(Plan(totals, None, 4096, 1024), {"a": 0, "b": 1}, pa.int64())(iter([at])))
    assert len(pieces) == 4  # one a slice
    joined = defaultdict(list)
    for p in pa.Table.from_batches(pieces).to_pylist():
        joined[p["key"]] += np.frombuffer(p["ids"], "<u4").tolist()
    assert [joined[i] for i in range(n)] == want


def test_small_local_tables_start_no_python_workers(spark, odd_docs, tmp_path, capsys):
    from sitesift.llm import mix as module
    from sitesift.llm.secret_scan import Ledger

    ledger = Ledger(spark, str(tmp_path / "ledger"))
    totals = odd_docs.selectExpr("source", "cast(n_chars as long) as n").groupBy("source").agg({"n": "sum", "*": "count"}).toDF("source", "source_size", "rows").collect()
    for t in (ledger.scanned(), ledger.findings(), module._plan(spark, totals, curriculum, None, 3)):
        t.explain()
        assert "ExistingRDD" not in capsys.readouterr().out
    assert ledger.scanned().isEmpty() and ledger.findings().dtypes == [
        ("blob", "string"), ("rule_version", "string"), ("kind", "string"), ("start", "bigint"), ("end", "bigint")]
    assert module._plan(spark, [], curriculum, None, 3).count() == 0
