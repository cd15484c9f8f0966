"""A sample spread over documents, and within each over kinds of chunks, every row with a class that it can carry.

Documents take turns, and so do a document's kinds: the k-th row of a kind comes in the document's k-th round. The order of turns is
that of seeded hashes. Row numbers within documents give every row its turn, and the first `count` turns are the sample, so nothing
but the sample is ever in one place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drawn(points: DataFrame, count: int, key: Column) -> DataFrame:
    """Adds turn and doc_key to the `count` rows of points (doc_id, chunk_id, chunk_type, classes) that are drawn. key(name) orders by a seeded hash."""
    able = points.where(F.size("classes") > 0).select("*", key("doc_id").alias("doc_key"), key("doc_id", "chunk_type").alias("type_key"), key("chunk_id").alias("own_key"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "chunk_type").orderBy("own_key", "chunk_id"))
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("nth", "type_key", "chunk_type"))
    return able.withColumn("nth", nth).withColumn("turn", turn).drop("nth", "type_key", "own_key").orderBy("turn", "doc_key", "doc_id").limit(count)


def stratified(points: DataFrame, count: int, classes: list[str], key) -> DataFrame:
    """(place, doc_id, chunk_id, chunk_type, query_class): the sample in the order of turns; each row gets that of its classes that the
    rows before it have least, the first in `classes` of equal ones. The fold goes over the sample alone."""
    kinds = {c: points.schema[c].dataType.simpleString() for c in ("doc_id", "chunk_id", "chunk_type")}

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "doc_key", "doc_id"], kind="stable")
        given = dict.fromkeys(classes, 0)
        out = []
        for able in rows["classes"]:
            out.append(min((c for c in classes if c in set(able)), key=given.__getitem__))
            given[out[-1]] += 1
        return rows.assign(query_class=out, place=range(1, len(out) + 1))[["place", *kinds, "query_class"]]

    fields = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return drawn(points, count, key).groupBy(F.lit("sample")).applyInPandas(fold, f"place int, {fields}, query_class string")
