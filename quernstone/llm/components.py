"""Connected components by contraction, with DataFrame operations; what is left below a bound is closed in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links (two ids each) that one task may close.
SMALL = 200_000


def _closed(edges: DataFrame) -> DataFrame:
    """(id, to) with the least id of each component, by union-find in one task over at most SMALL links."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
        if parent:
            yield pd.DataFrame({"id": list(parent), "to": [root(x) for x in list(parent)]})

    return edges.select("a", "b").repartition(1).mapInPandas(run, f"id {kind}, to {kind}")


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, component) for every id in links (a, b); component is the smallest id of its component.

    Each level, every id points to the first of itself and its neighbours (in the order of ids, then of a hash, by
    turns) and links are contracted to the pointers; the number of ids falls geometrically, and a star goes at once.
    Nothing is gathered by id, so an id with very many links is no hot spot. When no more than `small` links are left,
    one task closes them. An empty table gives an empty result.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    levels, level = [], 0
    while edges.count() > small:
        both = edges.unionByName(edges.selectExpr("b AS a", "a AS b"))
        if level % 2 == 0:
            first = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to"))
        else:
            rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(level)).alias("h"), F.col(c).alias("i"))
            first = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("id"), F.least(rank("a"), F.col("m"))["i"].alias("to"))
        pointers = written(first, f"pointers{level}")
        levels.append(pointers)
        edges = written(
            edges.join(pointers.selectExpr("id AS a", "to AS x"), "a").join(pointers.selectExpr("id AS b", "to AS y"), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            f"links{level + 1}",
        )
        level += 1
    root = written(_closed(edges), "closed").selectExpr("id", "to AS root")
    if not levels:
        return root.selectExpr("id", "root AS component")
    # an id that is only ever pointed to by others is a link's end itself, so every id has a root; roots are named by their least id
    for pointers in reversed(levels):
        root = pointers.join(root.selectExpr("id AS to", "root"), "to", "left").select("id", F.coalesce("root", "to").alias("root"))
    root = written(root, "roots")
    return root.join(root.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")
