"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, divergence, embeddings, langid, mixing, pii, point_in_time, quality, sharding, simhash, suffix_dedup, warc

MODULES = [suffix_dedup, simhash, warc, chat, mixing, decontaminate, sharding, embeddings, quality, langid, point_in_time, divergence, pii]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in vars(m).items() if k.startswith("op") and k[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    out = {"op7_extendible_sharding": sharding.OP7_SQL, "op11_point_in_time": point_in_time.OP11_SQL, "op12_divergence": divergence.OP12_SQL}
    return out
