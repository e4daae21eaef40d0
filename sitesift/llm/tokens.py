"""Token counts from a vocabulary of pre-tokens.

The tokenizer's normaliser and pre-tokenizer split a text into pre-tokens,
whose numbers of pieces do not depend on each other. So pieces are counted
once per distinct pre-token of the corpus, by the tokenizer library, and a
document's count is the sum over its pre-token frequencies joined to those
counts. No list of ids is ever kept.

The most frequent pre-tokens (a fixed number, short ones only, so their size
is bounded) reach all tasks as a broadcast dictionary: it joins them before
the shuffle, and none of the keys that remain is frequent. All others go
through an ordinary join.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import KEPT_CHARS, sliced, stage

HEAD_SIZE = 1 << 17
HEAD_CHARS = 64
#: Distinct words a task holds before it hands its counts on, and characters
#: of the texts it has taken them from.
TASK_WORDS, TASK_CHARS = 200_000, 1 << 25
#: Rows of a batch that a task hands on (a document's rows stay together).
TASK_ROWS = 20_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to str.split(), but not sure to be so for the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Here lower() and the letter classes agree in all libraries, and NFC changes nothing.
_PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]+")


class PreTokenizer:
    """The pre-tokens of a word (no ASCII white space inside), as the tokenizer file at ``path`` defines them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        if kinds != ["NFC", "Replace", "Lowercase"] or len(splits) != 1 or any(t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: not a lower-casing tokenizer with one split pattern")
        self.pattern = regex.compile(splits[0])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        if any(_ODD_SPACE.search(s) or not _WORD.fullmatch(s) for s in special):
            raise ValueError(f"{path}: special strings with white space")
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def words(self, text: str) -> list[str]:
        return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()

    def __call__(self, word: str) -> list[str]:
        if self.special and "<" in word and (m := self.special.search(word)):
            return [*self(word[: m.start()]), m[0], *self(word[m.end():])]  # specials come before normalisation
        if _PLAIN.fullmatch(word):
            return self.pattern.findall(word.lower())
        word = self.tokenizer.normalizer.normalize_str(word)
        return [word[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)]

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        """One by one: the library's batches start a thread for each core of
        the machine, all with memory of their own, in every Python worker."""
        return [len(self.tokenizer.encode(p, add_special_tokens=False)) for p in pre_tokens]


@lru_cache(maxsize=4)
def pre_tokenizer(path: str) -> PreTokenizer:
    return PreTokenizer(path)


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pre_token, n, pieces) of every distinct pre-token of the whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizer(path)
        held: Counter[str] = Counter()
        chars = 0

        def flush() -> pa.RecordBatch:
            pre: Counter[str] = Counter()
            for w, n in held.items():
                for p in split(w):
                    pre[p] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(pre), pa.string()), pa.array(list(pre.values()), pa.int64())], ["pre_token", "n"])

        for b in sliced(batches):
            for t in b.column(0).to_pylist():
                if t:
                    held.update(split.words(t))
                    chars += len(t)
                    if len(held) >= TASK_WORDS or chars >= TASK_CHARS:
                        yield flush()
                        chars = 0
        if held:
            yield flush()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizer(path)
        for b in batches:
            pieces = [n for x in sliced([b]) for n in split.pieces(x.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces, pa.int64())], ["pre_token", "n", "pieces"])

    counts = docs.select(text).mapInArrow(count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(measure, "pre_token string, n long, pieces long")


def most_frequent(vocab: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens, ``most`` of them at the most.
    Counts are put into classes of about 2 percent; the classes (some thousands
    at any size) say from which count on the pre-tokens are few enough, and
    only those reach the driver."""
    short = vocab.where(F.char_length("pre_token") <= HEAD_CHARS).withColumn("size", F.floor(F.log2("n") * 32).cast("int"))
    left, least = most, None
    for r in sorted(short.groupBy("size").count().collect(), reverse=True):
        if r["count"] > left:
            break
        left, least = left - r["count"], r.size
    if least is None:
        return {}
    return {r.pre_token: r.pieces for r in short.where(F.col("size") >= least).select("pre_token", "pieces").collect()}


def token_counts(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", head_size: int = HEAD_SIZE) -> DataFrame:
    """One row per input row: key, n_bytes (UTF-8) and n_tokens, without
    begin, end or added special tokens; special strings inside a text count
    as the one token they are.

    Null or empty text: 0 bytes, 0 tokens. Null key and repeated rows: each
    row is counted on its own. Empty table: empty result. Other columns are
    not looked at. Very long texts are held one at a time.
    """
    spark = docs.sparkSession
    vocab = stage(vocabulary(docs, path, text), "vocabulary")
    head = spark.sparkContext.broadcast(most_frequent(vocab, head_size))
    key_type = docs.schema[key].dataType
    arrow_key = to_arrow_type(key_type)
    schema = f"row long, key {key_type.simpleString()}, n_bytes long, pre_token string, n long"

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document one row with what the dictionary knows, under a key of
        its own that no pre-token has, and one per other pre-token."""
        from pyspark import TaskContext

        split, known = pre_tokenizer(path), head.value
        seen: dict[str, int | tuple[int, list[str]]] = {}
        row = TaskContext.get().partitionId() << 40
        for b in sliced(batches):
            rows, keys, sizes, pre, ns = [], [], [], [], []

            def batch() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(keys, arrow_key), pa.array(sizes, pa.int64()), pa.array(pre, pa.string()), pa.array(ns, pa.int64())],
                    ["row", "key", "n_bytes", "pre_token", "n"],
                )

            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total, tail = 0, Counter()
                for w in split.words(t) if t else ():
                    v = seen.get(w)
                    if v is None:
                        parts = split(w)
                        rest = [p for p in parts if p not in known]
                        v = sum(known[p] for p in parts if p in known)
                        v = (v, rest) if rest else v
                        if len(w) <= KEPT_CHARS:
                            if len(seen) >= TASK_WORDS:
                                seen.clear()
                            seen[w] = v
                    if v.__class__ is int:
                        total += v
                    else:
                        total += v[0]
                        tail.update(v[1])
                rows.append(row), keys.append(k), sizes.append(len(t.encode()) if t else 0), pre.append(f"\0{row}"), ns.append(total)
                rows += [row] * len(tail)
                keys += [None] * len(tail)
                sizes += [None] * len(tail)
                pre += tail.keys()
                ns += tail.values()
                row += 1
                if len(rows) >= TASK_ROWS:
                    yield batch()
                    rows, keys, sizes, pre, ns = [], [], [], [], []
            if rows:
                yield batch()

    parts = docs.select(F.col(key), F.col(text)).mapInArrow(frequencies, schema)
    counted = parts.join(vocab.select("pre_token", "pieces"), "pre_token", "left").withColumn(
        "n", F.col("n") * F.coalesce(F.col("pieces"), F.lit(1))
    )
    per_row = counted.groupBy("row").agg(
        F.max("key").alias("key"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")
    )
    return per_row.select(F.col("key").alias(key), "n_bytes", "n_tokens")
