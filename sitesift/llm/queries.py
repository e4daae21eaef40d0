"""All training-data queries; importing the modules below registers them."""

from __future__ import annotations

from . import q01_mix, q02_url, q03_tokens, q04_embed, q05_rules, q06_toxicity, q07_warc, q08_packing, q09_secrets, q10_minhash, q11_license, q12_merkle, q13_periodic  # noqa: F401
from .registry import QUERIES


def queries() -> dict:
    return {k: v[0] for k, v in QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in QUERIES.items() if v[1] is not None}
