"""Removal of repeated passages over a compacted de Bruijn graph of words.

The graph's edges are windows of 20 words. Windows of a document that share their least 8-word seed follow each other
and are one path from the start; equal windows have equal seeds, so only paths whose seed occurs again can repeat. Joins
by seed and words count how often each path occurs and sum up where its occurrences begin and end. Where all ends of one
path are beginnings of the next one, and all its beginnings are such ends, the graph doesn't branch between them, and
both compact into one path, however long it gets. The words of every occurrence of a compact path are then read at their
source coordinates and digested (128 bits); of equal ones the first in the corpus stays and the others go as a whole.
Where a seed leads into several different paths the graph branches; the first places of those paths are digested window
by window. All decisions are made on the input as it was. The 64-bit hashes of words only propose; without an equal
digest of the words themselves nothing goes.

Defined results: a document without 20 words, or without text, loses nothing; equal texts lose all words in every
document but the first, if they have 20; a null id is not compared and loses nothing; a document is an id with its text:
rows that repeat both are one document and get the same result, different texts of one id are different documents (those
of one id come in the order of a hash of the text); an empty table gives an empty result. cut() carries all other
columns, whatever their names; elsewhere they are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, unused, written

WINDOW, SEED = 20, 8
#: Places in a document are packed as first window * 32 + windows; a path has at most WINDOW - SEED + 1 windows.
PACK = 32
#: Rows that a worker gathers before it passes them on.
FLUSH = 1 << 17

_C = np.uint64(0xD6E8FEB86659FD93)
_C_INVERSE = np.uint64(pow(int(_C), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def split(text: str | None) -> list[bytes]:
    """Words between the ASCII blanks, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = out * _C + h[k : len(h) - size + 1 + k]
    return _mixed(out)


def windows(h: np.ndarray, size: int = WINDOW) -> np.ndarray:
    return _rolled(h, size)


class Powers:
    """Powers of the multiplier and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _C)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _C_INVERSE)]), dtype=np.uint64)


_POWERS = Powers()


def paths(h: np.ndarray, size: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed, hash of all words, and packed place of each path of a document with these word hashes."""
    m = len(h) - size + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    mers = _rolled(h, seed)
    best, at = mers[:m].copy(), np.zeros(m, np.int64)
    for d in range(1, size - seed + 1):
        less = mers[d : d + m] < best
        np.copyto(best, mers[d : d + m], where=less)
        at[less] = d
    place = at + np.arange(m)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(start, m))
    n = len(h) + 1
    _POWERS.to(n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * _POWERS.up[: n - 1], dtype=np.uint64)])
    whole = (sums[start + count + size - 1] - sums[start]) * _POWERS.down[start]
    whole = _mixed(whole + (count * 64 + place[start] - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mers[place[start]], whole, start * PACK + count


def nodes(df: DataFrame, id_column: str, text_column: str, variant: str) -> DataFrame:
    """df with a column that tells the texts of one id apart: 0 where an id has one text only, else the text's hash."""
    i, text = F.col(f"`{id_column}`"), F.xxhash64(F.coalesce(F.col(f"`{text_column}`"), F.lit("")))
    several = df.where(i.isNotNull()).groupBy(i.alias("id")).agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("lo <> hi")
    several = written(several.select(F.col("id").alias(id_column), F.lit(True).alias(variant)), "several")
    return df.join(several, id_column, "left").withColumn(variant, F.when(F.col(variant), text).otherwise(F.lit(0).cast("long")))


def _path_rows(df: DataFrame) -> DataFrame:
    """(seed, path, id, v, place) of every path of df (id, v, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list, batch: pd.DataFrame) -> pd.DataFrame:
            k, n = np.array([r[0] for r in rows]), [len(r[1]) for r in rows]
            found = [np.concatenate(x) for x in list(zip(*rows, strict=True))[1:]]
            ids = {c: np.repeat(batch[c].to_numpy()[k], n) for c in ("id", "v")}
            return pd.DataFrame({"seed": found[0].view(np.int64), "path": found[1].view(np.int64), **ids, "place": found[2]})

        for batch in batches:
            rows, size = [], 0
            for k, text in enumerate(batch["text"]):
                found = paths(hashes(split(text)))
                if len(found[0]):
                    rows.append((k, *found))
                    size += len(found[0])
                if size >= FLUSH:
                    yield frame(rows, batch)
                    rows, size = [], 0
            if rows:
                yield frame(rows, batch)

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "v", "text").mapInPandas(run, f"seed long, path long, id {kind}, v long, place long")


class Spans:
    """The words of a text by their numbers."""

    def __init__(self, text: str | None):
        words = split(text)
        self.joined = b" ".join(words)
        self.at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).tolist()

    def digest(self, first: int, windows: int) -> bytes:
        """Of the words that so many windows cover, from the window `first` on."""
        from xxhash import xxh3_128_digest

        return xxh3_128_digest(self.joined[self.at[first] : self.at[first + windows + WINDOW - 1] - 1])


def compacted(place: np.ndarray, into: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of the compact paths of one document, from its paths' places (in order)."""
    first, n = place // PACK, place % PACK
    follows = (first[1:] == first[:-1] + n[:-1]) & (out[:-1] == into[1:])
    head = np.flatnonzero(np.concatenate([[True], ~follows]))
    tail = np.append(head[1:], len(place)) - 1
    return first[head], first[tail] + n[tail] - first[head]


def _spans(texts: DataFrame, spots: DataFrame) -> DataFrame:
    """(hi, lo, id, v, first, windows): the digest of the words of each compact path of a document, and of each window
    at the places where the graph branches. spots has id, v, place, into, out (both null at branches)."""
    # sets, as a row that occurs very often gives the same places each time
    lists = written(spots.groupBy("id", "v").agg(F.collect_set(F.struct("place", "into", "out")).alias("spots")), "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots, digests, who, first, windows = batch.column("spots"), [], [], [], []
            flat, ends = spots.flatten(), spots.offsets.to_numpy() - spots.offsets[0].as_py()
            place = flat.field("place").to_numpy(zero_copy_only=False)
            branch = flat.field("out").is_null().to_numpy(zero_copy_only=False)
            into, out = (flat.field(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("into", "out"))
            for k, text in enumerate(batch.column("text").to_pylist()):
                own = slice(ends[k], ends[k + 1])
                b, p = branch[own], place[own]
                path, at = np.unique(p[~b], return_index=True)
                single = np.unique(p[b])
                f, n = compacted(path, into[own][~b][at], out[own][~b][at]) if len(path) else (path, path)
                each = [np.arange(x // PACK, x // PACK + x % PACK) for x in single.tolist()]
                f = np.concatenate([f, *each])
                n = np.concatenate([n, np.ones(len(f) - len(n), np.int64)])
                digest = Spans(text).digest
                digests += map(digest, f.tolist(), n.tolist())
                who.append(np.full(len(f), k)), first.append(f), windows.append(n)
            if not digests:
                continue
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            who = pa.array(np.concatenate(who))
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("id").take(who), batch.column("v").take(who), pa.array(np.concatenate(first).astype(np.int64)), pa.array(np.concatenate(windows).astype(np.int64))],
                names=["hi", "lo", "id", "v", "first", "windows"],
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "v", "text").join(lists, ["id", "v"]).mapInArrow(run, f"hi long, lo long, id {kind}, v long, first long, windows long")


def removals(df: DataFrame) -> DataFrame:
    """id, v, cuts (first, windows): for documents that lose words, the windows that are repeated. df has id, v, text."""
    df = df.where("id IS NOT NULL")
    rows = written(_path_rows(df), "rows")
    # tables of their own, so that a seed with very many rows can be split in the joins
    again = written(rows.groupBy("seed").count().where("count > 1").select("seed"), "again")
    row = written(rows.join(again, "seed"), "repeated")
    begin, end = F.xxhash64("id", "v", F.expr(f"place div {PACK}")), F.xxhash64("id", "v", F.expr(f"place div {PACK} + place % {PACK}"))
    low = lambda h: F.try_sum(h.bitwiseAND(F.lit((1 << 31) - 1)))
    at = F.struct("id", "v", "place")
    path = row.groupBy("seed", "path").agg(
        F.count("*").alias("n"), F.min(at).alias("at"), F.bit_xor(begin).alias("b1"), low(begin).alias("b2"), F.bit_xor(end).alias("e1"), low(end).alias("e2")
    )
    path = written(path, "paths")
    more = written(path.where("n > 1").select("seed", "path", F.xxhash64("n", "b1", "b2").alias("into"), F.xxhash64("n", "e1", "e2").alias("out")), "nodes")
    branch = written(path.groupBy("seed").count().where("count > 1").select("seed"), "branch")
    none = F.lit(None).cast("long")
    spots = row.join(more, ["seed", "path"]).select("id", "v", "place", "into", "out")
    spots = spots.unionByName(path.join(branch, "seed").select("at.id", "at.v", "at.place", none.alias("into"), none.alias("out")))
    span = written(_spans(df, spots), "spans")
    at = F.struct("id", "v", "first")
    equal = written(span.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(at).alias("at")).where("n > 1").select("hi", "lo", "at"), "equal")
    later = span.join(equal, ["hi", "lo"]).where("struct(id, v, first) <> at")
    return later.groupBy("id", "v").agg(F.collect_set(F.struct("first", "windows")).alias("cuts"))


def kept_words(words: list[bytes], first: np.ndarray, windows: np.ndarray) -> tuple[list[bytes], int]:
    """The words outside all cut windows, and the number of the others."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + windows + WINDOW - 1, -1)
    stay = np.cumsum(change[:-1]) == 0
    return [w for w, s in zip(words, stay.tolist(), strict=True) if s], int((~stay).sum())


def cut(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None, names: tuple[str, str, str, str] = ("n_words", "n_removed", "kept", "kept_sha256")) -> DataFrame:
    """Every row of df with the columns carried (all, if not said) and, under the given names: the number of words, that of
    the removed ones, what is kept (words joined by a space; null where nothing goes) and the digest of the kept words."""
    carry = df.columns if carry is None else carry
    variant, cuts = unused([*df.columns, *names], "variant", "cuts")
    known = nodes(df, id_column, text_column, variant)
    lists = written(removals(known.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{variant}`").alias("v"), F.col(f"`{text_column}`").alias("text"))), "cuts")
    lists = lists.select(F.col("id").alias(id_column), F.col("v").alias(variant), F.col("cuts").alias(cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = batch.column(cuts), []
            flat, ends = own.flatten(), own.offsets.to_numpy()
            ends = ends - ends[0]
            first, windows = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "windows"))
            for k, text in enumerate(batch.column(text_column).to_pylist()):
                words = split(text)
                a, b = ends[k], ends[k + 1]
                kept, gone = kept_words(words, first[a:b], windows[a:b]) if b > a else (words, 0)
                joined = b" ".join(kept)
                rows.append((len(words), gone, joined.decode("utf-8", "surrogatepass") if gone else None, hashlib.sha256(joined).hexdigest()))
            new = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], *map(pa.array, new, kinds)], names=[*carry, *names])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry] + [f"`{c}` {k}" for c, k in zip(names, ("long", "long", "string", "string"), strict=True)]
    need = list(dict.fromkeys([*carry, text_column, cuts]))
    return known.join(lists, [id_column, variant], "left").select(*[F.col(f"`{c}`") for c in need]).mapInArrow(run, ", ".join(kinds))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without words of 20-word windows that start earlier in the corpus."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return cut(docs, carry=["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
