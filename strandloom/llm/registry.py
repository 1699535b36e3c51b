"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from ..shipping import shipped
from . import decontamination, html, media, minhash, perplexity, pii, sentencepiece, sharding, suffixes, warc

MODULES = (sharding, html, minhash, media, decontamination, sentencepiece, perplexity, pii, suffixes, warc)


def queries() -> dict:
    return {k: shipped(f) for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
