"""Queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "hybrid_search_benchmark"
MODULES: tuple[str, ...] = tuple(f"quernstone.plans.{m}" for m in ("retrieval", "texts", "ingest", "evaluation", "answers", "streams", "passages", "payloads", "fields", "gold", "expansions", "listings", "books", "legs", "verdicts", "wishes", "certificates", "replays"))


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in getattr(import_module(m), "ORACLES", {}).items()}
