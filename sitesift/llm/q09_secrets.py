"""Query op9: secrets in all documents, from an empty ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read, scratch
from .registry import register
from .secret_scan import RULES, Ledger, scan_versions, spans_text

BASE = [r.kind for r in RULES["base-1"]]


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern, group, least length of the group
_SQL_RULES = {
    "assign": (_ASSIGN, 2, 8),
    "access": ("(AKIA[A-Z0-9]+)", 1, 16),
    "hex": ("([0-9a-f]+)", 1, 32),
    "pem": (r"(-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:[^-]|-{1,4}[^-])*-----END [A-Z ]{0,40}PRIVATE KEY-----|(?:[\x20\t\r\n]*[A-Za-z0-9+/=]{16,})*))", 1, 1),
    "github": ("(gh[pousr]_[A-Za-z0-9]{36,})", 1, 1),
    "slack": ("(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 1),
    "jwt": (r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 1, 1),
}
_MATCHES = " UNION ALL ".join(
    f"""SELECT doc_id, '{kind}' AS kind, {k} AS ord, {least} AS least, unnest(list_zip(range(1, len(whole) + 1),
    list_transform(regexp_split_to_array(text, '{p}'), lambda g: length(g))[:len(whole)], list_transform(whole, lambda m: length(m)),
    list_transform(regexp_extract_all(text, '{p}', {g}), lambda v: length(v)))) AS z
    FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}', 0) AS whole FROM d WHERE regexp_matches(text, '{p}'))"""
    for k, (kind, (p, g, least)) in enumerate(_SQL_RULES.items())
)
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_MATCHES}),
y AS (
  SELECT doc_id, kind, ord, least, z[4] AS n, z[3] AS size, sum(z[2] + z[3]) OVER (PARTITION BY doc_id, kind ORDER BY z[1]) AS e FROM m),
s AS (SELECT doc_id, kind, ord, (e - size)::BIGINT AS b, kind || ':' || (e - size)::BIGINT || ':' || e::BIGINT AS span FROM y WHERE n >= least),
a AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY b, ord) FILTER (WHERE ord < 3) AS base,
         string_agg(span, ',' ORDER BY b, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


@register("op9_secret_scan", SQL)
def op9_secret_scan(spark, sf_dir):
    """Counts, digest and spans of every document."""
    found = scan_versions(read(spark, sf_dir, "documents"), Ledger(spark, scratch(spark, "ledger")))
    kinds = F.transform("findings", lambda f: f["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans"))
