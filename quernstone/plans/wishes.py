"""A wish list made of the benchmark's passages against a catalog made of all documents, with SQL over all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage
from ..sources.tables import table

_N = "lpad(CAST(doc_id % {} AS STRING), 4, '0')"
CATALOG = f"""SELECT CASE doc_id % 4 WHEN 0 THEN 'SC23-' || {_N.format(4000)} || '-0' || CAST(doc_id % 3 AS STRING) WHEN 1 THEN 'SG24-' || {_N.format(300)} WHEN 2 THEN 'redp' || {_N.format(200)} ELSE 'stem-' || CAST(doc_id AS STRING) END AS doc_id, title FROM firsts"""
ITEMS = """SELECT item_id AS id, CASE WHEN item_id % 3 = 0 THEN 'doc_number' ELSE 'title' END AS "match", CASE WHEN item_id % 3 = 0 THEN 'SC23-' || lpad(CAST(item_id * 8 % 4000 AS STRING), 4, '0') END AS one, CASE WHEN item_id % 6 = 0 THEN 'SG24-' || lpad(CAST(item_id * 4 % 300 + 1 AS STRING), 4, '0') END AS two,
    item_id % 4 = 1 AS expect_many, CASE item_id % 5 WHEN 0 THEN 'sc' WHEN 1 THEN 'S' END AS prefix, w FROM words"""


def _records(spark, d):
    """(items, titles): titles are first words of documents, with an apostrophe in some."""
    first = F.array_join(F.slice(F.split("text", r"\s+"), 1, 7), " ")
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 > 0, F.concat(first, F.when(F.col("doc_id") % 2 == 0, F.lit(" User’s  Guide")).otherwise(""))).alias("title"))
    titles = spark.sql(CATALOG.replace("FROM firsts", "FROM {firsts}"), firsts=docs)
    words = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    made = spark.sql(ITEMS.replace("FROM words", "FROM {words}").replace('"match"', "`match`"), words=words)
    groups = F.array(F.slice("w", 1, 2), F.array(F.get("w", F.lit(2)), F.lit("USERS' guide")), F.slice("w", 5, 1))
    return made.select("id", "match", F.array_compact(F.array("one", "two")).alias("numbers"), F.when(F.col("id") % 7 > 0, groups).alias("groups"), F.when(F.col("prefix").isNotNull(), F.array("prefix")).alias("prefixes"), "expect_many"), titles


def coverage_of(spark, d):
    return coverage.covered(*_records(spark, d))


def coverage_counts(spark, d):
    return coverage_of(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.sum("n").alias("documents"))


QUERIES = {"jn16_coverage": coverage_of, "ag39_coverage_counts": coverage_counts}

_WORD = "regexp_matches(title, '(^|[^0-9a-z])' || {} || '($|[^0-9a-z])')"
_ALL = f"""WITH firsts AS (SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN array_to_string(string_split_regex(text, '\\s+')[1:7], ' ') || CASE WHEN doc_id % 2 = 0 THEN ' User’s  Guide' ELSE '' END END AS title FROM documents),
words AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{{2,}}') AS w FROM benchmark), items AS ({ITEMS}),
cat AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(replace(replace(title, '’', ''), '''', '')), '\\s+', ' ', 'g')) AS title, CASE WHEN regexp_full_match(upper(replace(doc_id, '-', '')), '(REDP\\d{{4}}|[A-Z]{{2,4}}\\d{{6}})(\\d{{2}})?') THEN regexp_extract(upper(replace(doc_id, '-', '')), '^(REDP\\d{{4}}|[A-Z]{{2,4}}\\d{{6}})', 1) ELSE doc_id END AS family FROM ({CATALOG}) c),
num AS (SELECT DISTINCT id, doc_id FROM items, cat WHERE family IN (replace(one, '-', ''), replace(two, '-', ''))),
tit AS (SELECT DISTINCT id, doc_id, family FROM items, cat WHERE id % 7 > 0 AND (prefix IS NULL OR starts_with(upper(doc_id), upper(prefix)))
  AND (({_WORD.format('lower(w[1])')} AND {_WORD.format('lower(w[2])')}) OR ({_WORD.format('lower(w[3])')} AND {_WORD.format("'users guide'")}) OR {_WORD.format('lower(w[5])')})),
n AS (SELECT id, count(*) AS n FROM num GROUP BY id), t AS (SELECT id, count(*) AS n, count(*) FILTER (regexp_full_match(doc_id, '(?i:SG24|REDP)-?\\d{{4}}(-?\\d{{2}})?')) AS pub, count(DISTINCT family) AS f FROM tit GROUP BY id),
out AS (SELECT i.id, CASE WHEN n.n > 0 OR (t.n > 0 AND "match" = 'title' AND (f = 1 OR expect_many)) THEN 'present' WHEN t.n > 0 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN n.n > 0 THEN 'doc_number' WHEN t.n > 0 THEN 'title' END AS matched_by,
  coalesce(n.n, t.n, 0) AS n, coalesce(n.n, t.pub, 0) AS n_public FROM items i LEFT JOIN n USING (id) LEFT JOIN t USING (id))"""
ORACLES = {
    "jn16_coverage": f"{_ALL} SELECT * FROM out",
    "ag39_coverage_counts": f"{_ALL} SELECT status, count(*) AS n, CAST(sum(n) AS BIGINT) AS documents FROM out GROUP BY status",
}
