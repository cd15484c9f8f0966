"""jn20_switch_pairs on odd and on large sources, against its SQL and against a fold from the end."""

import random
import time

import duckdb

from pyspark.sql import functions as F

from quernstone.plans import evaluation, registry

KIND = "doc_id long, source string, lang string"


def pairs(spark, tmp_path, data):
    spark.createDataFrame(data, KIND).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, registry.queries()["jn20_switch_pairs"](spark, str(tmp_path)).collect()), key=str)


def in_duck(tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    return sorted(con.execute(registry.oracle_sql()["jn20_switch_pairs"]).fetchall(), key=str)


def test_odd_sources(spark, tmp_path):
    """Missing languages, sources and one id; sources of one document, of one language, of one change, and with a change between blocks only."""
    rng, data = random.Random(20), [(None, "a", "de"), (-7, None, "en"), (-8, None, "de"), (-5, "one", "en"), (-6, "none", None)]
    data += [(rng.randrange(-(10**12), 10**12), s, rng.choice(langs)) for s, n, langs in [("a", 40, ["en", "de", None]), ("b", 300, ["en", "de", "fr"]), ("c", 90, ["en"] * 30 + ["de"]), ("d", 30, ["en"]), ("e", 30, [None, "de"]), ("", 9, ["x", ""])] for _ in range(n)]
    data += [(i, "f", "en" if i < 100 else "de") for i in range(200)] + [(i, "g", "en" if i < 1999 else "de") for i in range(2000)]
    got = pairs(spark, tmp_path, data)
    assert got == in_duck(tmp_path)
    assert (199, 0) in got and (0, 100) in got and not any(i in (-7, -8, -5, -6) for i, _ in got)


def test_no_documents(spark, tmp_path):
    assert pairs(spark, tmp_path, []) == []


def test_documents_of_one_id(spark, tmp_path):
    """Several documents of an id follow in the order of their languages; each has its partner."""
    data = [(i // 3, "a", lang) for i, lang in enumerate(random.Random(4).choices(["en", "de", "fr"], k=300))]
    rows = sorted((i, lang) for i, _, lang in data)
    want = [(rows[k][0], next(i for i, lang in rows[k:] + rows if lang != rows[k][1])) for k in range(len(rows))]
    assert pairs(spark, tmp_path, data) == sorted(want, key=str)


def test_a_source_is_many_blocks(spark, tmp_path):
    """No task has to see a source whole."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.when(F.col("id") % 7 > 0, "en").otherwise("de").alias("lang"))
    sizes = [r["count"] for r in evaluation._neighbours(docs).groupBy("source", "block").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 10_000


def test_time_grows_with_the_rows(spark, tmp_path):
    """A source of 60,000 documents; over two minutes, when each row looked at all rows after it."""
    n = 60_000
    lang = F.when(F.col("id") % 1000 == 999, "de").otherwise("en")
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), lang.alias("lang")).write.parquet(f"{tmp_path}/documents.parquet")
    start = time.monotonic()
    got = dict(map(tuple, registry.queries()["jn20_switch_pairs"](spark, str(tmp_path)).collect()))
    assert time.monotonic() - start < 60
    # an English document's partner closes its thousand, a German one's opens the next
    assert got == {i: (i + 1) % n if i % 1000 == 999 else i // 1000 * 1000 + 999 for i in range(n)}
