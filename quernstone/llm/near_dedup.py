"""Near-duplicate documents by SetSketch registers over word shingles.

A document's set holds the hashes of its distinct shingles. Register i of its sketch is a truncated minimum on an
exponential scale: with x the least of the set's exponential values under hash i, the register is floor(1 - log_b x)
within 16 bits. Registers of a union are the maxima of the registers, and two sets agree in a register with a chance
close to their similarity. Bands of registers are bucketed; within a bucket, documents meet a few pivots instead of one
another; a joint maximum-likelihood estimate from the registers sorts out pairs far below the threshold, and the rest
are confirmed on their full sets. Links are closed to components between rounds, and a pair inside one component isn't
compared any more. Before each further round, documents go that cannot link to another component, as too few of their
shingles occur there: with a similarity of t, a share t of a set is in the other. Rounds go on, with more pivots each
time, until every bucket has met in full, so no bucket is capped.

With 32 bands of 4 registers, a pair at the threshold of 0.75 shares no bucket with a chance of 5e-6.

Defined results: a document without words, or without text, has no shingles and is linked with nothing; with fewer words
than a shingle, the whole sequence is its one shingle; equal sets are linked; a null id is linked with nothing and kept;
different texts of one id are different documents, and component_id is the least id that any of them reaches, each by itself
(such ids have to be whole numbers or strings); rows that repeat id and text fare alike; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, written
from .components import components

WORDS, PERCENT = 5, 75
REGISTERS, BAND = 128, 4
# Parameters of the sketch: base, rate and the largest register.
BASE, RATE, LARGEST = 1.001, 20.0, 65535
#: Pairs estimated below this are 6.5 standard errors below the threshold and are not confirmed.
LEAST_ESTIMATE = 0.5

_ODD = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, (2, REGISTERS), np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of the whole text."""
    from xxhash import xxh3_64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for k in range(min(words, len(h))):
        out = out * _STEP + h[k : k + n]
    return np.unique(_mixed(out))


def sketch(found: np.ndarray) -> np.ndarray:
    """Registers of a set of hashes; those of a union are the maxima of its parts'."""
    least = np.full(REGISTERS, ~np.uint64(0))
    for k in range(0, len(found), 4096):
        np.minimum(least, (found[None, k : k + 4096] * _ODD[0][:, None] + _ODD[1][:, None]).min(1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-12)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarities by joint maximum likelihood from registers (pairs, REGISTERS) and the sets' sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = REGISTERS - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, 65)[None, :] * top[:, None]
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = chance(u[:, None] - v[:, None] * j), chance(v[:, None] - u[:, None] * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    score = more[:, None] * log(up) + less[:, None] * log(down) + same[:, None] * log(1 - up - down)
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def sketches(df: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """id, n_shingles, digest of the set (null if empty) and the sketch, of each whole text."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sizes, digests, made = [], [], []
            for text in batch["text"]:
                found = shingles(text, words)
                sizes.append(len(found))
                digests.append(xxh3_128_digest(found.tobytes()) if len(found) else None)
                made.append(sketch(found).tobytes() if len(found) else None)
            yield pd.DataFrame({"id": batch["id"], "n_shingles": sizes, "digest": digests, "sketch": made})

    return df.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text").mapInPandas(run, f"id {kind}, n_shingles long, digest binary, sketch binary")


def _confirmed(pairs: DataFrame, held: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that reach the threshold: their sizes must allow it, their registers not speak against
    it, and their full sets show it. held has id, n, sketch and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent: dict = {}

        def of(i, text):
            if i not in recent:
                if len(recent) >= 64:
                    recent.clear()
                recent[i] = shingles(text, words)
            return recent[i]

        for batch in batches:
            if not len(batch):
                continue
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
            batch = batch[estimate(x, y, batch["na"].to_numpy(float), batch["nb"].to_numpy(float)) >= LEAST_ESTIMATE]
            good = []
            for i, j, x, y in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
                s, t = of(i, x), of(j, y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(t) - both) > 0)
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    kind = pairs.schema["a"].dataType.simpleString()
    one = held.selectExpr("id AS a", "n AS na", "sketch AS sa", "text AS ta")
    two = held.selectExpr("id AS b", "n AS nb", "sketch AS sb", "text AS tb")
    sized = pairs.join(one, "a").join(two, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return sized.mapInPandas(run, f"a {kind}, b {kind}")


def _apart(rows: DataFrame, tag: str) -> DataFrame:
    """Rows (key, id, c) of buckets that hold more than one component, with the bucket's size n."""
    size = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    return written(rows.join(size.select("key", "n"), "key"), tag)


def _open(rows: DataFrame, texts: DataFrame, words: int, percent: int, tag: str) -> DataFrame:
    """(id, useful) of the documents in rows (key, id, size, c) that may still link to another component.

    useful counts the shingles that other components' documents hold. A similarity of t needs t / (1 + t) of both sets'
    sizes in common, and the other set is no smaller than the least in the document's buckets, nor than t of its own; fewer
    useful shingles than that rule a link out. A document that is ruled out holds nothing for others, so this is repeated
    while it rules out many.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t, words) for t in batch["text"]]
            sizes = [len(x) for x in found]
            if sum(sizes):
                yield pd.DataFrame({"s": np.concatenate(found).view(np.int64), "id": np.repeat(batch["id"].to_numpy(), sizes), "c": np.repeat(batch["c"].to_numpy(), sizes)})

    least = rows.groupBy("key").agg(F.min("size").alias("least"))
    docs = rows.join(least, "key").groupBy("id").agg(F.first("c").alias("c"), F.first("size").alias("size"), F.min("least").alias("least"))
    docs = written(docs.withColumn("need", F.expr(f"{percent} * (size + greatest(least, size * {percent} / 100)) / {100 + percent}")), f"docs-{tag}")
    held = written(texts.join(docs.select("id", "c"), "id").select("id", "c", "text").mapInPandas(run, f"s long, id {kind}, c {kind}"), f"held-{tag}")
    left = docs
    for turn in range(8):
        useful = held.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("s")
        count = held.join(useful, "s").groupBy("id").agg(F.count("*").alias("useful"))
        open_ = written(docs.join(count, "id").where("useful >= need - 1e-6").select("id", "useful"), f"open-{tag}-{turn}")
        before, after = left.count(), open_.count()
        if after >= 0.95 * before or not after:
            break
        left = open_
        held = held.join(left.select("id"), "id", "left_semi")
    return open_


def _told_apart(df: DataFrame, id_column: str, text_column: str, words: int, percent: int) -> DataFrame:
    """near_duplicates() where an id has several texts: its documents are named by the id, in the ids' order, and a digest of the text."""
    kind, own = df.schema[id_column].dataType, F.col(f"`{id_column}`")
    if isinstance(kind, T.StringType):
        place, back = own, lambda c: F.substring(c, F.lit(1), F.length(c) - 65)
    elif isinstance(kind, T.IntegralType):
        sign = F.lit(-(1 << 63))
        place = F.lpad(F.hex(own.cast("long").bitwiseXOR(sign)), 16, "0")
        back = lambda c: F.conv(F.substring(c, 1, 16), 16, -10).cast("long").bitwiseXOR(sign).cast(kind)
    else:
        raise ValueError("ids that have several texts must be whole numbers or strings")
    named = df.select(F.concat(place, F.lit("\0"), F.sha2(F.coalesce(F.col(f"`{text_column}`"), F.lit("")), 256)).alias("node"), F.col(f"`{text_column}`").alias("text"))
    found = near_duplicates(named, "node", "text", words, percent)
    out = found.select(back(F.col("id")).alias("id"), "n_shingles", back(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id (least id of the component), kept, for every row."""
    every = written(sketches(df, id_column, text_column, words), "sketches")
    held = every.where("id IS NOT NULL AND digest IS NOT NULL")
    first = held.groupBy("digest").agg(F.min("id").alias("rep"))
    member = written(held.select("id", "digest").distinct().join(first, "digest").select("id", "rep"), "members")
    if member.groupBy("id").count().where("count > 1").head(1):
        return _told_apart(df, id_column, text_column, words, percent)
    band = F.expr(f"transform(sequence(0, {REGISTERS // BAND - 1}), i -> xxhash64(i, substring(sketch, i * {2 * BAND} + 1, {2 * BAND})))")
    own = held.join(member.where("id = rep").select("id").distinct(), "id").dropDuplicates(["id"])
    nodes = written(own.select("id", "n_shingles", "sketch", band.alias("keys")), "nodes")
    slots = nodes.select("id", F.col("n_shingles").alias("size"), F.explode("keys").alias("key"))
    crowded = slots.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    bucket = written(slots.join(crowded, "key"), "buckets")

    texts = None

    def compare(pairs: DataFrame, tag: str) -> DataFrame:
        """Confirms pairs; texts are fetched once, for all documents that share a bucket."""
        nonlocal texts
        if texts is None:
            need = bucket.select("id").distinct()
            found = df.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text").join(need, "id").dropDuplicates(["id"])
            texts = written(found.join(nodes.selectExpr("id", "n_shingles AS n", "sketch"), "id"), "texts")
        return written(_confirmed(pairs, texts, words, percent), f"links-{tag}")

    stars = written(bucket.where("id <> hub").selectExpr("hub AS a", "id AS b").distinct(), "stars")
    # first each document with the least of its hubs, then with those that are still in other components
    least = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = compare(least, "least")
    reach = written(components(links), "reach-least")

    def labelled(rows: DataFrame, column: str, label: str) -> DataFrame:
        found = reach.selectExpr(f"id AS {column}", f"component AS {label}")
        return rows.join(found, column, "left").withColumn(label, F.coalesce(label, column))

    rest = labelled(labelled(stars.join(least, ["a", "b"], "left_anti"), "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")
    links = links.unionByName(compare(rest, "stars"))
    reach = written(components(links), "reach-stars")
    done = stars

    active, turn = bucket.where("id <> hub").select("key", "id", "size"), 0
    while True:
        now = _apart(labelled(active, "id", "c"), f"active-{turn}")
        if not now.head(1):
            break
        open_ = _open(now, texts, words, percent, str(turn)).join(nodes.select("id", "keys"), "id")
        now = _apart(now.drop("n").join(open_, "id"), f"open-{turn}")
        if not now.head(1):
            break
        if turn == 0:  # the one with most of its shingles elsewhere links to whatever can be linked
            share = F.struct((F.col("useful") / F.col("size")).alias("share"), "id", "c", "size", "useful", "keys")
            left = now.groupBy("key").agg(F.max(share).alias("x")).select("key", "x.*")
        else:
            left = now.where(F.pmod(F.xxhash64("id", "key", F.lit(turn)), F.col("n")) < 16**turn)
        left = written(left.selectExpr("key", "id AS p", "c AS cp", "size AS zp", "useful AS up", "keys AS kp"), f"pivots-{turn}")
        # a pair meets in the first of the buckets it shares, once
        once = "" if turn == 0 else "AND (p < id OR pmod(xxhash64(id, key, {t}), n) >= {m}) ".format(t=turn, m=16**turn)
        enough = F.expr(f"cp <> c {once}AND {100 + percent} * least(useful, up) >= {percent} * (size + zp) AND get(array_intersect(kp, keys), 0) = key")
        met = left.join(now.select("key", "id", "c", "n", "size", "useful", "keys"), "key").where(enough).select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct()
        fresh = written(met.join(done, ["a", "b"], "left_anti"), f"met-{turn}")
        found = compare(fresh, f"turn-{turn}")
        done = done.unionByName(fresh)
        if found.head(1):
            links = links.unionByName(found)
            reach = written(components(links), f"reach-{turn}")
        active, turn = now.select("key", "id", "size").join(left.selectExpr("key", "p AS id"), ["key", "id"], "left_anti"), turn + 1

    whole = member.join(reach.selectExpr("id AS rep", "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    whole = whole.groupBy("id").agg(F.min("component").alias("component_id"))
    out = every.select("id", "n_shingles").join(whole, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under five-word shingles and a similarity of 0.75."""
    return near_duplicates(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}
