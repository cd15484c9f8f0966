"""Byte-level BPE encoding and decoding in numpy.

A text is cut into words by a pattern; distinct words that the worker doesn't remember go into padded matrices by their
length. Every round merges in each row the leftmost pair of least rank (found by a hashed pair table), so each row loses
one column a round; rows without a pair that can merge are done and leave the matrix. Words too long for a matrix use a
heap with the same rule.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated rows each give their own result;
an empty table gives an empty result; only the id and text columns are read, so other columns' names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents
from .word_cache import WordCache

NONE = np.int32(2**31 - 1)
#: Matrix widths in bytes; longer words take the heap.
WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128)
WIDTH_OF = [next(w for w in WIDTHS if n <= w) for n in range(WIDTHS[-1] + 1)]
CELLS = 1 << 20


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing over numpy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(8, (2 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        left = np.array([a for a, _ in pairs], np.int64).reshape(-1)
        right = np.array([b for _, b in pairs], np.int64).reshape(-1)
        keys, values = (left << 32) | right, np.array(list(pairs.values()), np.int32)
        slot = self._slot(keys)
        self.probes = 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several keys for one slot the last stays
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out.reshape(shape)


class Merger:
    """Merges words of bytes. first and last give the id of a byte within a word and at its end; a merged token's id is
    also its rank."""

    def __init__(self, first: np.ndarray, last: np.ndarray, pairs: dict[tuple[int, int], int]):
        self.first, self.last, self.pairs, self.table = first, last, pairs, PairTable(pairs)
        self.pad = 1 + max(int(first.max()), int(last.max()), *pairs.values())

    def merge(self, raws: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers. No word is empty."""
        out: list[bytes] = [b""] * len(raws)
        rows: dict[int, list[tuple[int, bytes]]] = {w: [] for w in WIDTHS}
        for i, raw in enumerate(raws):
            if len(raw) > WIDTHS[-1]:
                out[i] = self._heap(raw)
            else:
                rows[WIDTH_OF[len(raw)]].append((i, raw))
        for width, group in rows.items():
            step = max(1, CELLS // width)
            for k in range(0, len(group), step):
                self._matrix(group[k : k + step], width, out)
        return out

    def _matrix(self, group: list[tuple[int, bytes]], width: int, out: list[bytes]) -> None:
        where = np.array([i for i, _ in group])
        size = np.array([len(raw) for _, raw in group])
        raw = np.frombuffer(b"".join([raw.ljust(width, b"\0") for _, raw in group]), np.uint8).reshape(-1, width)
        ids = self.first[raw]
        row = np.arange(len(size))
        ids[row, size - 1] = self.last[raw[row, size - 1]]
        ids[np.arange(width) >= size[:, None]] = self.pad
        ranks = self.table.ranks(ids[:, :-1], ids[:, 1:])
        while len(where):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(where), np.int64)
            best = np.take_along_axis(ranks, at[:, None], 1)[:, 0] if ranks.shape[1] else np.full(len(where), NONE)
            done = best == NONE
            if done.any():
                flat, w = ids[done].astype("<u4"), 4 * ids.shape[1]
                raw = flat.tobytes()
                for k, (i, n) in enumerate(zip(where[done].tolist(), size[done].tolist(), strict=True)):
                    out[i] = raw[k * w : k * w + 4 * n]
                left = ~done
                where, size, ids, ranks, at, best = where[left], size[left], ids[left], ranks[left], at[left], best[left]
                if not len(where):
                    return
            row = np.arange(len(where))
            ids[row, at] = best
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            size = size - 1
            columns = np.arange(ranks.shape[1] - 1)
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            has = at > 0
            ranks[row[has], at[has] - 1] = self.table.ranks(ids[row[has], at[has] - 1], ids[row[has], at[has]])
            has = at < ranks.shape[1]
            ranks[row[has], at[has]] = self.table.ranks(ids[row[has], at[has]], ids[row[has], at[has] + 1])

    def _heap(self, raw: bytes) -> bytes:
        ids = self.first[np.frombuffer(raw, np.uint8)].tolist()
        ids[-1] = int(self.last[raw[-1]])
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = lambda i: self.pairs.get((ids[i], ids[after[i]])) if after[i] < n else None
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (q := pair(k)) is not None:
                    heapq.heappush(heap, (q, k, ids[k], ids[after[k]]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()


class ByteBPE:
    """Encoder and decoder for ranks in the tiktoken format; a token's id is its rank."""

    def __init__(self, rank_file: bytes, pattern: str):
        import regex

        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.token = {i: t for t, i in self.rank.items()}
        single = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, i in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.merger = Merger(single, single, pairs)
        self.find = regex.compile(pattern).findall
        self.cache = WordCache(self.split, self.encode_words)

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pattern's matches in each text."""
        words = list(map(self.find, texts))
        return pa.array(list(chain.from_iterable(words)), pa.large_string()), np.fromiter(map(len, words), np.int64, len(words))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """A word that is a token as a whole takes its id; the others are merged."""
        raws = [w.encode() for w in words]
        whole = list(map(self.rank.get, raws))
        merged = iter(self.merger.merge([raw for raw, i in zip(raws, whole, strict=True) if i is None]))
        return [next(merged) if i is None else i.to_bytes(4, "little") for i in whole]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_BUILT: dict[str, ByteBPE] = {}


def built(rank_file: bytes, pattern: str) -> ByteBPE:
    """The encoder of this worker, built once."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ByteBPE(rank_file, pattern)
    return _BUILT[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids as an array, of each whole text.

    The vocabulary file (under 1 MB) is read by the driver and broadcast.
    """
    with open(ranks_path, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = built(file.value, pattern)
        for batch in batches:
            tokens, hashed, back, kept = [], [], [], []
            for ids in bpe.cache.ids(batch["text"]):
                tokens.append(len(ids) // 4)
                hashed.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
            out = pd.DataFrame({"id": batch["id"], "n_tokens": tokens, "ids_sha256": hashed, "decoded_sha256": back})
            yield out.assign(ids=kept) if keep_ids else out

    kind = df.schema[id_column].dataType.simpleString()
    read = df.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text")
    return read.mapInPandas(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document encoded by the multilingual byte-level ranks and decoded again."""
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
