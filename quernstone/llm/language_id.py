"""Language identification with hyperdimensional profiles.

Every letter has a random vector of plus and minus ones, drawn from its code point. A trigram's vector binds its letters'
vectors, each permuted by its place; a document's vector bundles its trigrams; a language's prototype bundles the unit
vectors of labelled documents, and what all prototypes share is taken off. A document gets the language whose prototype
has the largest cosine with it.

Defined results: a null text, or one without letters, is `und` with score 0, as is every text when nothing was learned;
ties go to the language that sorts first; repeated rows each get their result; an empty table gives an empty result;
an id has no part in a prediction, so repeated ids may have
different texts; other columns than those named are not read, and carried ones pass unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, unused

DIMENSIONS = 512
SEED = 20_011
#: Labelled documents learned from, at most about this many (expected); the rest of them add nothing to the prototypes.
LEARN_FROM = 20_000
UNKNOWN = "und"
#: Letters beyond the Latin blocks share this many vectors.
DIRECT, LETTERS = 0x250, 4096
#: Trigrams whose vectors are made at a time.
TRIGRAMS = 16_384


@cache
def letter_classes() -> np.ndarray:
    """0 for what isn't a letter; else a number below LETTERS."""
    codes = np.arange(0x110000, dtype=np.int64)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    spread = DIRECT + ((codes * 2654435761) >> 7) % (LETTERS - DIRECT)
    return np.where(letter, np.where(codes < DIRECT, codes, spread), 0).astype(np.int16)


@cache
def letter_vector(letter: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, letter])).choice(np.array([-1, 1], np.int8), DIMENSIONS)


@cache
def letter_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of all letters, permuted by the place in a trigram: twice, once, not at all."""
    plain = np.stack([letter_vector(k) for k in range(LETTERS)])
    return np.roll(plain, 2, 1), np.roll(plain, 1, 1), plain


def bound(keys: np.ndarray) -> np.ndarray:
    """Vectors of trigrams: their letters' permuted vectors, multiplied."""
    first, second, third = letter_table()
    return first[keys >> 24] * second[keys >> 12 & 4095] * third[keys & 4095]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a whole text and their counts; letters are in lower case, and what isn't one is a blank."""
    none = np.empty(0, np.int64)
    letters = letter_classes()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not letters.any():
        return none, none
    edge = np.zeros(len(letters) + 2, np.int64)
    edge[1:-1] = letters
    edge = edge[np.concatenate([[True], (edge[1:] != 0) | (edge[:-1] != 0)])]
    return np.unique((edge[:-2] << 24) | (edge[1:-1] << 12) | edge[2:], return_counts=True)


def bundles(texts: Iterable[str | None]) -> Iterator[np.ndarray | None]:
    """Each text's vector, or None without letters. Integer-valued, so the order of adding doesn't matter.

    The vectors of trigrams are made once for a few texts together, which hold TRIGRAMS of them or little more; a text
    with more is added up in parts.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def made() -> Iterator[np.ndarray | None]:
        every = np.unique(np.concatenate([k for k, _ in held])) if held else np.empty(0, np.int64)
        rows = bound(every) if len(every) <= 2 * TRIGRAMS else None
        for keys, counts in held:
            if not len(keys):
                yield None
            elif rows is not None:
                yield counts.astype(np.float32) @ rows[np.searchsorted(every, keys)].astype(np.float32)
            else:
                yield sum(counts[k : k + TRIGRAMS].astype(np.float64) @ bound(keys[k : k + TRIGRAMS]) for k in range(0, len(keys), TRIGRAMS))

    for text in texts:
        held.append(trigrams(text))
        size += len(held[-1][0])
        if size >= TRIGRAMS:
            yield from made()
            held, size = [], 0
    yield from made()


def learn(df: DataFrame, language: str, id_column: str, text_column: str, learn_from: int = LEARN_FROM) -> dict[str, np.ndarray]:
    """Prototypes by language, from a bounded sample of rows chosen by a hash of their id."""
    labelled = df.where(F.col(language).isNotNull()).select(F.col(id_column).alias("id"), F.col(language).alias("lang"), F.col(text_column).alias("text"))
    rows = labelled.count()
    if not rows:
        return {}
    share = min(1.0, learn_from / rows)
    sample = labelled.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, v in zip(batch["lang"], bundles(batch["text"]), strict=True):
                if v is not None and (norm := float(np.sqrt(np.dot(v.astype(np.float64), v)))):
                    made[lang] = made.get(lang, 0) + np.rint(v * (1e6 / norm)).astype(np.int64)
        if made:
            yield pd.DataFrame({"lang": list(made), "vector": list(made.values())})

    parts = sample.mapInPandas(run, "lang string, vector array<long>").select("lang", F.posexplode("vector"))
    sums = parts.groupBy("lang", "pos").agg(F.sum("col").alias("n")).collect()  # languages times DIMENSIONS
    found: dict[str, np.ndarray] = {}
    for lang, pos, n in sums:
        found.setdefault(lang, np.zeros(DIMENSIONS))[pos] = n
    return {k: found[k] / np.linalg.norm(found[k]) for k in sorted(found) if np.any(found[k])}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = (), names_out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """id and carried columns with lang_pred and score (the cosine, mapped to 0 to 1). Only the text decides."""
    names = list(prototypes)
    raw = np.array([prototypes[k] for k in names]).reshape(len(names), DIMENSIONS)
    apart = raw - raw.mean(0) if len(names) > 1 else raw
    apart = apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = [], []
            texts = batch.column(source).to_pylist()
            for v in bundles(texts) if names else [None] * len(texts):
                norm = 0.0 if v is None else float(np.sqrt(np.dot(v.astype(np.float64), v)))
                if not norm:
                    pred.append(UNKNOWN), score.append(0.0)
                    continue
                cosine = apart @ (v / norm).astype(np.float64)
                best = int(cosine.argmax())
                pred.append(names[best]), score.append(min(1.0, max(0.0, round((1 + float(cosine[best])) / 2, 9))))
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*kept, *names_out])

    kept = [id_column, *carry]
    source = text_column if text_column in kept else unused(kept, "text")[0]
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    read = [F.col(f"`{c}`") for c in kept] + [F.col(f"`{text_column}`").alias(source)] * (source not in kept)
    return df.select(*read).mapInArrow(run, f"{kinds}`{names_out[0]}` string, `{names_out[1]}` double")


def held_out(id_column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from labelled documents outside the held-out third."""
    docs = documents(spark, sf_dir)
    prototypes = learn(docs.where(~held_out()), "lang", "doc_id", "text")
    return predict(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
