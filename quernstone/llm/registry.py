"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sharding", "bpe", "token_counts", "packing", "language_id", "media", "near_dedup", "substring_dedup", "pii", "fingerprints", "segment_bpe", "sessions", "importance")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f".{m}", __package__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in getattr(import_module(f".{m}", __package__), "ORACLES", {}).items()}
