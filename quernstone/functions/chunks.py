"""Chunks of texts: paragraphs packed up to a size with an overlap, statements kept whole.

The fold over a text's paragraphs has state, so it runs per text in Arrow batches; nothing is gathered across texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

# A block's size, what the next one repeats, and the namespace of chunk ids.
BLOCK, OVERLAP = 3500, 400
STATEMENT = ("//", "/*", ">>")


def units(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, atomic) of the paragraphs of a text; runs of statement lines are one atomic unit."""
    out, at = [], 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            atomic = line.startswith(STATEMENT)
            if atomic and out and out[-1][2] and out[-1][1] == at - 1:
                out[-1] = (out[-1][0], end, True)
            else:
                out.append((at, end, atomic))
        at = end + 1
    return out


def pieces(start: int, end: int, text: str, size: int) -> Iterator[tuple[int, int]]:
    """A long paragraph in pieces of at most size, cut after a sentence or at a blank where there is one."""
    while end - start > size:
        window = text[start : start + size]
        cut = max(window.rfind(". ") + 2, window.rfind("\t") + 1)
        cut = cut if cut > size // 2 else (window.rfind(" ") + 1 or size)
        yield start, start + cut
        start += cut
    if end > start:
        yield start, end


def blocks(text: str, size: int = BLOCK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the blocks: no block is longer than size unless it is one atomic unit; prose repeats its tail."""
    parts = [(s, e, a) for s, e, a in units(text) for s, e in ([(s, e)] if a else pieces(s, e, text, size))]
    out: list[tuple[int, int]] = []
    first = 0
    for i, (s, e, _) in enumerate(parts):
        if i > first and e - parts[first][0] > size:
            out.append((parts[first][0], parts[i - 1][1]))
            first = i
            while first > 0 and not parts[first - 1][2] and e - parts[first - 1][0] <= size and parts[i - 1][1] - parts[first - 1][0] <= overlap:
                first -= 1
    if parts:
        out.append((parts[first][0], parts[-1][1]))
    return out


def chunked(df: DataFrame, key: str, source: str, text: str, size: int = BLOCK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ordinal, start, end, chunk_id, body) of every text. A null or blank text has no chunks."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, rev, body in zip(batch["k"].tolist(), batch["rev"], batch["body"], strict=True):
                for n, (s, e) in enumerate(blocks(body or "", size, overlap)):
                    rows.append((k, n, s, e, str(uuid.uuid5(uuid.NAMESPACE_URL, f"{rev}|{k}|0|{n}")), body[s:e]))
            yield pd.DataFrame(rows, columns=[key, "ordinal", "start", "end", "chunk_id", "body"])

    return df.selectExpr(f"`{key}` AS k", f"`{source}` AS rev", f"`{text}` AS body").mapInPandas(run, f"`{key}` {kind}, ordinal int, start int, end int, chunk_id string, body string")
