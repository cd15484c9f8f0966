"""Rules over queries, messages and references."""

from __future__ import annotations

import base64
import re


def expanded(query: str, glossary: dict[str, str], short: frozenset[str] = frozenset({"CF", "LU", "EE"})) -> str:
    """A query with `TOKEN (Expansion)` added for the acronyms it holds; two-letter ones only from a reviewed set."""
    found = {}
    for token in re.findall(r"\b[A-Za-z0-9]+(?:/[A-Za-z0-9]+)?\b", query or ""):
        key = token.upper()
        if key in glossary and key not in found and (len(key) > 2 or key in short):
            found[key] = f"{token} ({glossary[key]})"
    return " ".join([query, *found.values()]) if found else query


def encode_reference(build: str, chunk_id: str, digest: str) -> str:
    """An evidence reference of a build, a chunk and a digest, in one token."""
    return base64.urlsafe_b64encode("\x1f".join((build, chunk_id, digest)).encode()).decode().rstrip("=")


def decode_reference(token: str) -> tuple[str, str, str]:
    parts = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode().split("\x1f")
    if len(parts) != 3:
        raise ValueError("not a reference")
    return parts[0], parts[1], parts[2]


def fitted(message: str, budget: int, price) -> tuple[str, int]:
    """A message cut in its middle to a token budget, and how many characters went."""
    if price(message) <= budget:
        return message, 0
    lo, hi = 0, len(message) // 2
    while lo < hi:  # the longest equal head and tail that fit
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if price(message[:mid] + " … " + message[-mid:]) <= budget else (lo, mid - 1)
    return (message[:lo] + " … " + message[-lo:] if lo else "…"), len(message) - 2 * lo
