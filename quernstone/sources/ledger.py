"""Ledgers, golden sets and exports kept as lines of text, and files walked as rows."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("rules_version", T.StringType()),
        T.StructField("finished_at", T.DoubleType()),
    ]
)
GOLDEN = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("query_class", T.StringType()),
        T.StructField("expected_behavior", T.StringType()),
        T.StructField("expected_doc_ids", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
    ]
)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of every key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_nth", last).where("_nth = 1").drop("_nth")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Latest record of each path; a torn line counts as none."""
    lines = spark.read.schema(T.StructType([*LEDGER.fields, T.StructField("_torn", T.StringType())])).option("columnNameOfCorruptRecord", "_torn").json(path)
    return latest(lines.where("_torn IS NULL AND path IS NOT NULL").drop("_torn"), "path", "finished_at", "sha256")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden rows without comments; a line that isn't one, or a candidate among them, refuses the file."""
    text = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    rows = text.select(F.from_json("value", GOLDEN, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    refused = F.assert_true(F.coalesce(F.col("status"), F.lit("")) != "candidate", "a candidate row is among the golden rows")
    return rows.withColumn("_ok", refused).where("_ok IS NULL").drop("_ok")


def walk(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """path, relpath, vendor, product, version and sha256 of files below root, without hidden folders.

    Labels come from paths of exactly vendor/product/version/file.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace("path", f"^.*?{base}/", "")
    parts = F.split(rel, "/")
    label = lambda i: F.when(F.size(parts) == 4, parts[i]).alias(("vendor", "product", "version")[i])
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin("__MACOSX", "lost+found"))
    return found.where(~hidden).select("path", rel.alias("relpath"), label(0), label(1), label(2), F.sha2("content", 256).alias("sha256"))


def export(answers: list[dict], ratings: list[dict]) -> bytes:
    """Header, answers and ratings in canonical JSON lines, and a trailer with counts and a digest. For bounded exports."""
    line = lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    body = [line({"kind": "header", "version": 1}), *(line({"kind": "answer"} | a) for a in answers), *(line({"kind": "rating"} | r) for r in ratings)]
    text = "\n".join(body) + "\n"
    return (text + line({"kind": "trailer", "answers": len(answers), "ratings": len(ratings), "sha256": hashlib.sha256(text.encode()).hexdigest()}) + "\n").encode()


def parse_export(data: bytes) -> tuple[list[dict], list[dict]]:
    """Answers and ratings of an export; wrong counts or digest refuse it."""
    *body, last = data.decode().rstrip("\n").split("\n")
    trailer, rows = json.loads(last), [json.loads(x) for x in body]
    answers, ratings = [r for r in rows if r["kind"] == "answer"], [r for r in rows if r["kind"] == "rating"]
    digest = hashlib.sha256(("\n".join(body) + "\n").encode()).hexdigest()
    if trailer.get("kind") != "trailer" or (trailer["answers"], trailer["ratings"], trailer["sha256"]) != (len(answers), len(ratings), digest):
        raise ValueError("the export is torn or was changed")
    return answers, ratings
