"""Byte-level BPE by segment trees over the ranks of adjacent pairs.

A tree's leaves are the pairs of a word, by place; each holds its rank and place in one number, and each inner node the least
of its two below. So the root is the leftmost pair of least rank. A merge changes the pair itself, the one before and the one
after, and the nodes above these three; it goes on until the root is empty. Words of like lengths share a matrix of trees and
merge side by side in numpy; a word beyond WIDEST has a tree of its own with the same rule. Each distinct word is merged
once while the worker remembers it. Added tokens are cut out of a text before the pattern sees it.

Defined results: a null or empty text has no tokens and decodes to an empty one; repeated rows each give their own result; an
empty table gives an empty result; texts are whole, however long; only the id and text columns are read, so other columns'
names can't clash.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import NONE, PairTable
from .common import documents
from .packing import byte_letters
from .word_cache import WordCache

EMPTY = np.int64(1 << 62)
#: Words of more bytes have a tree of their own.
WIDEST = 128
#: Tree nodes in a matrix.
NODES = 1 << 21
#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class SegmentTree:
    """The least of some leaves, with point updates. Leaves are numbers; absent ones are EMPTY."""

    def __init__(self, leaves: list[int]):
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.node = [int(EMPTY)] * self.width + leaves + [int(EMPTY)] * (self.width - len(leaves))
        for i in range(self.width - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    @property
    def root(self) -> int:
        return self.node[1]

    def put(self, at: int, value: int) -> None:
        node, i = self.node, self.width + at
        node[i] = value
        while i > 1:
            i >>= 1
            least = min(node[2 * i], node[2 * i + 1])
            if node[i] == least:
                return
            node[i] = least


class Merges:
    """Merges words of bytes. ids: of single bytes; pairs: (left id, right id) -> (rank, id of both together)."""

    def __init__(self, ids: np.ndarray, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.ids, self.pairs = ids, pairs
        self.table = PairTable({k: rank for k, (rank, _) in pairs.items()})
        self.made = np.zeros(1 + max((rank for rank, _ in pairs.values()), default=0), np.int64)
        for rank, both in pairs.values():
            self.made[rank] = both

    def merge(self, raws: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers. No word is empty."""
        out: list[bytes] = [b""] * len(raws)
        alike: dict[int, list[int]] = {}
        for i, raw in enumerate(raws):
            if len(raw) > WIDEST:
                out[i] = self._alone(raw)
            else:
                alike.setdefault(max(1, (len(raw) - 1).bit_length()), []).append(i)
        for bits, rows in alike.items():
            step = NODES >> (bits + 1)
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                for i, ids in zip(some, self._together([raws[i] for i in some], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _alone(self, raw: bytes) -> bytes:
        ids = self.ids[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), None], [None, *range(n - 1)]

        def leaf(i: int) -> int:
            found = self.pairs.get((ids[i], ids[after[i]])) if after[i] is not None else None
            return int(EMPTY) if found is None else found[0] * n + i

        tree = SegmentTree([leaf(i) for i in range(n)])
        while tree.root < EMPTY:
            rank, i = divmod(tree.root, n)
            j = after[i]
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[i] is not None:
                before[after[i]] = i
            tree.put(j, int(EMPTY))
            tree.put(i, leaf(i))
            if before[i] is not None:
                tree.put(before[i], leaf(before[i]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def _leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        rank = self.table.ranks(left, right)
        return np.where(rank == NONE, EMPTY, rank.astype(np.int64) * width + place)

    def _together(self, raws: list[bytes], width: int) -> Iterator[bytes]:
        """A tree a row, all of one width. Rows whose root is empty are done."""
        rows = len(raws)
        size = np.fromiter(map(len, raws), np.int64, rows)
        place = np.arange(width)
        ids = self.ids[np.frombuffer(b"".join([raw.ljust(width, b"\0") for raw in raws]), np.uint8)].reshape(rows, width)
        tree = np.full((rows, 2 * width), EMPTY)
        leaves = self._leaves(ids[:, :-1], ids[:, 1:], place[:-1], width)
        tree[:, width:-1] = np.where(place[1:] < size[:, None], leaves, EMPTY)
        level = width
        while level > 1:
            level //= 2
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        alive = place < size[:, None]
        # flat views: a token's place is row * width + place, a node's row * 2 * width + node; a spare place at the end stands for none
        none = rows * width
        ids, alive, tree = np.append(ids.ravel(), 0), np.append(alive.ravel(), False), tree.ravel()
        after, before = np.arange(1, none + 2), np.arange(-1, none)
        after[np.arange(rows) * width + size - 1] = none
        before[np.arange(rows) * width] = none
        row = np.arange(rows)
        while True:
            root = tree[row * 2 * width + 1]
            row, root = row[root < EMPTY], root[root < EMPTY]
            if not len(row):
                break
            i = row * width + root % width
            j = after[i]
            ids[i] = self.made[root // width]
            alive[j] = False
            k, p = after[j], before[i]
            after[i], before[k] = k, i
            after[none] = before[none] = none
            for at, left, right in ((i, i, k), (p, p, i)):
                ok = (left != none) & (right != none)
                tree[row * 2 * width + np.where(left == none, 0, width + at % width)] = np.where(ok, self._leaves(ids[left], ids[right], at % width, width), EMPTY)
            tree[row * 2 * width + width + j % width] = EMPTY
            base = np.concatenate([row, row, row]) * 2 * width
            node = width + np.concatenate([i % width, j % width, np.where(p == none, i, p) % width])
            for _ in range(width.bit_length() - 1):
                node >>= 1
                tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
        flat, ends = ids[alive].astype("<u4").tobytes(), 4 * np.cumsum(alive[:-1].reshape(rows, width).sum(1))
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            yield flat[a:b]


def newer_letters() -> str:
    """Letters and numbers that Python's own tables don't know yet, as ranges of a character class."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    starts = [c for c, b in zip(found, [-1, *found], strict=False) if c != b + 1]
    ends = [c for c, a in zip(found, [*found[1:], -1], strict=True) if a != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) or chr(0x10FFFF)


class TreeBPE:
    """Encoder and decoder for a byte-level tokenizers file."""

    def __init__(self, file: str):
        import regex
        from tokenizers import Tokenizer

        parts = json.loads(file)
        model, cutter = parts["model"], parts["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or parts["normalizer"] or parts["post_processor"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError("not a plain byte-level tokenizer")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in parts["added_tokens"]):
            raise ValueError("added tokens that look at what stands beside them aren't supported")
        vocab, letters = model["vocab"], byte_letters()
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.merges = Merges(np.array([vocab[x] for x in letters], np.int64), pairs)
        byte = {x: i for i, x in enumerate(letters)}
        self.added = {a["content"]: a["id"] for a in parts["added_tokens"]}
        self.decimal = list(map(str, range(1 + max([*vocab.values(), *self.added.values()]))))
        raw = lambda t: bytes([byte[x] for x in t]) if all(x in byte for x in t) else t.encode()
        self.token = {i: raw(t) for t, i in [*vocab.items(), *self.added.items()]}
        # the added token that begins first is cut out, of those that begin at one place the longest
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.find = regex.compile(PATTERN).findall
        newer = newer_letters()
        self.unsure = regex.compile(f"[{newer}]").search
        self.beyond = re.compile(f"[{min(newer.replace('-', ''))}-{chr(0x10FFFF)}]").search
        self.cutter = Tokenizer.from_str(file).pre_tokenizer.pre_tokenize_str
        self.cache = WordCache(self.split, self.encode_words)

    def cut(self, text: str) -> list[str]:
        """The pattern's matches. Whether a letter of a new version of Unicode is one depends on the library, so it is asked."""
        if text.isascii() or not self.beyond(text) or not self.unsure(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.cutter(text)]

    def words(self, text: str) -> list[str]:
        if self.apart is None or not self.apart.search(text):
            return self.cut(text)
        return [w for k, part in enumerate(self.apart.split(text)) for w in ([part] if k % 2 else self.cut(part))]

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        words = list(map(self.words, texts))
        return pa.array(list(chain.from_iterable(words)), pa.large_string()), np.fromiter(map(len, words), np.int64, len(words))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """A word that reads like an added token is one, as those are cut out wherever they stand."""
        merged = iter(self.merges.merge([w.encode() for w in words if w not in self.added]))
        return [self.added[w].to_bytes(4, "little") if w in self.added else next(merged) for w in words]

    def listed(self, ids: np.ndarray) -> str:
        """Decimal ids, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


_BUILT: dict[str, TreeBPE] = {}


def built(file: str) -> TreeBPE:
    """The encoder of this worker, built once."""
    key = hashlib.sha256(file.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = TreeBPE(file)
    return _BUILT[key]


def encode(df: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids as an array, of each whole text.

    The tokenizer's file (under 2 MB) is read by the driver and broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = built(file.value)
        for batch in batches:
            tokens, hashed, back, kept = [], [], [], []
            for raw in bpe.cache.ids(batch["text"]):
                ids = np.frombuffer(raw, "<u4")
                tokens.append(len(ids))
                hashed.append(hashlib.sha256(bpe.listed(ids).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            out = pd.DataFrame({"id": batch["id"], "n_tokens": tokens, "ids_sha256": hashed, "decoded_sha256": back})
            yield out.assign(ids=kept) if keep_ids else out

    kind = df.schema[id_column].dataType.simpleString()
    read = df.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text")
    return read.mapInPandas(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op11_segment_tree_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document encoded by the byte-level vocabulary and decoded again."""
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


QUERIES = {"op11_segment_tree_bpe": op11_segment_tree_bpe}
