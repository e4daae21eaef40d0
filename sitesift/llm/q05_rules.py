"""Query op5: quality rules over all documents, certified on the labels per language."""

from __future__ import annotations

from .common import read
from .registry import register
from .rules import RULES, judge_quality

MAX_REJECTED, DELTA = 0.05, 0.05


_VALUES = ", ".join(f"({k}, {i}, {c})" for k, (_, _, cutoffs) in enumerate(RULES) for i, c in enumerate(cutoffs))
_STATISTIC = "CASE rule " + " ".join(f"WHEN {k} THEN {s}" for k, (_, s, _) in enumerate(RULES)) + " END"
_RATE = MAX_REJECTED / len(RULES)
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(str_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
g AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(g.n, 0) AS n_repeat_words
  FROM d LEFT JOIN g ON g.doc_id = d.doc_id),
good AS (
  SELECT s.* FROM s WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
grid(rule, i, c) AS (VALUES {_VALUES}),
k AS (
  SELECT lang, rule, i, c, count(*) AS n, count(*) FILTER (WHERE {_STATISTIC} > c) AS k,
         (SELECT count(DISTINCT lang) FROM good) AS strata
  FROM good, grid GROUP BY ALL),
tail AS (
  SELECT *, CASE WHEN k < n * {_RATE} THEN list_sum(list_transform(range(0, k + 1), lambda x:
    exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({_RATE}) + (n - x) * ln(1 - {_RATE})))) ELSE 1 END AS p FROM k),
run AS (
  SELECT lang, rule, c, i, bool_and(p <= {DELTA} / (strata * {len(RULES)})) OVER (PARTITION BY lang, rule ORDER BY i) AS ok FROM tail),
cut AS (SELECT lang, rule, arg_max(c, i) AS cutoff FROM run WHERE ok GROUP BY lang, rule),
bad AS (SELECT DISTINCT doc_id FROM s JOIN cut ON cut.lang = s.lang WHERE {_STATISTIC} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept
FROM s
"""


@register("op5_quality_rules", SQL)
def op5_quality_rules(spark, sf_dir):
    """Statistics and verdict of every document."""
    q = judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), max_rejected=MAX_REJECTED, delta=DELTA)
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
