"""An inverted file of vectors: cells around centroids, codes of a byte a number, candidates scored again on whole vectors.

Centroids are fitted on a sample of at most SAMPLE rows; every row is indexed. Codes and vectors are stored by cell, so a search
opens only the folders of cells that one of its queries probes, and within a cell only the queries that probe it are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from .ranking import QUERY_BLOCK, _best, _unit, top

#: Rows that centroids are fitted on, at most about; rounds of fitting; cells, at most.
SAMPLE, ROUNDS, CELLS = 20_000, 12, 4096
#: Share of the cells that a query probes, and candidates for each row asked for.
REACH, OVERSAMPLE = 0.65, 3


@dataclass
class Index:
    """codes: cell, key, code, scale. whole: cell, key, vector. sizes: rows of each cell (one number a cell)."""

    centroids: np.ndarray
    codes: DataFrame
    whole: DataFrame
    sizes: np.ndarray
    key: str


def fitted(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors; an empty cell starts anew at a row."""
    rng = np.random.default_rng(seed)
    found = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = (sample @ found.T).argmax(1)
        found = _unit(np.array([sample[own == c].mean(0) if (own == c).any() else sample[rng.integers(len(sample))] for c in range(len(found))]))
    return found


def build(vectors: DataFrame, key: str, vector: str, cells: int | None = None) -> Index:
    """Indexes every row. A null vector is left out."""
    spark, rows = vectors.sparkSession, vectors.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector))
    n = rows.count()
    share = max(1, -(-n // SAMPLE))
    sample = [r[0] for r in rows.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select(vector).toLocalIterator()]
    wanted = cells or min(CELLS, 1 << max(2, int(math.log2(max(1, n)) / 2) - 1))
    centroids = fitted(_unit(np.array(sample, float)), wanted) if sample else np.zeros((0, 0))
    held = spark.sparkContext.broadcast(centroids)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                unit = _unit(np.array(batch[vector].tolist(), float))
                scale = np.maximum(np.abs(unit).max(1), 1e-12) / 127
                codes = np.round(unit / scale[:, None]).astype(np.int8)
                yield pd.DataFrame({key: batch[key], vector: batch[vector], "code": [c.tobytes() for c in codes], "scale": scale, "cell": (unit @ held.value.T).argmax(1)})

    path = shared.folder(spark)
    element = vectors.schema[vector].dataType.simpleString()
    coded = shared.stored(rows.mapInPandas(run, f"`{key}` {kind}, `{vector}` {element}, code binary, scale double, cell int").repartition("cell"), f"{path}/rows", "cell")
    sizes = np.zeros(len(centroids), int)
    for c, m in coded.groupBy("cell").count().collect():
        sizes[c] = m
    return Index(centroids, coded.select("cell", key, "code", "scale"), coded.select("cell", key, vector), sizes, key)


def probed(index: Index, queries: np.ndarray, reach: float) -> np.ndarray:
    """(queries, cells) whether a query probes a cell: the nearest ones, a share `reach` of all."""
    near = queries @ index.centroids.T
    cut = np.argsort(-near, axis=1, kind="stable")[:, : max(1, math.ceil(reach * len(index.centroids)))]
    out = np.zeros(near.shape, bool)
    np.put_along_axis(out, cut, True, 1)
    return out


def search(queries: DataFrame, query_key: str, vector: str, index: Index, k: int, reach: float = REACH, oversample: int = OVERSAMPLE) -> DataFrame:
    """(query, key, score, rank, rows_read): approximate top-k. Candidates come from codes in the probed cells, oversample times k
    a query, and are scored again on whole vectors. rows_read counts the codes that were scored for the query."""
    key, parts = index.key, []
    rows = iter(queries.where(F.col(vector).isNotNull()).select(query_key, vector).toLocalIterator())
    own, name = index.codes.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    spark, dims = queries.sparkSession, index.centroids.shape[1]
    while len(index.centroids) and (block := list(islice(rows, QUERY_BLOCK))):
        matrix = _unit(np.array([r[1] for r in block], float))
        names, meets = np.array([r[0] for r in block]), probed(index, matrix, reach)
        held = spark.sparkContext.broadcast((matrix, names, meets))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            matrix, names, meets = held.value
            for batch in batches:
                for cell, part in batch.groupby("cell"):
                    asks = np.flatnonzero(meets[:, cell])
                    codes = np.frombuffer(b"".join(part["code"]), np.int8).reshape(-1, dims) * part["scale"].to_numpy()[:, None]
                    for a in range(0, len(asks), 512):
                        some = asks[a : a + 512]
                        rough = matrix[some] @ codes.T
                        i, j = _best(rough, part[key].to_numpy(), k * oversample)
                        yield pd.DataFrame({query_key: names[some][i], key: part[key].to_numpy()[j], "rough": rough[i, j]})

        cells = [int(c) for c in np.flatnonzero(meets.any(0))]
        rough = index.codes.where(F.col("cell").isin(cells)).mapInPandas(run, f"`{query_key}` {name}, `{key}` {own}, rough double")
        told = spark.createDataFrame([(r[0], int(m)) for r, m in zip(block, meets @ index.sizes, strict=True)], f"`{query_key}` {name}, rows_read long")
        parts.append(top(rough, [query_key], [F.desc("rough"), F.col(key)], k * oversample).drop("rank").join(told, query_key))
    if not parts:
        return spark.createDataFrame([], f"`{query_key}` {name}, `{key}` {own}, score double, rank int, rows_read long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    asked = queries.select(query_key, F.col(vector).alias("asked"))
    pairs = found.join(index.whole, key).join(asked, query_key)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    score = F.round(dot("asked", vector) / F.greatest(F.sqrt(dot("asked", "asked") * dot(vector, vector)), F.lit(1e-12)), 6)
    return top(pairs.select(query_key, key, score.alias("score"), "rows_read"), [query_key], [F.desc("score"), F.col(key)], k)
