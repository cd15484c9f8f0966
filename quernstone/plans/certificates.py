"""Completion of every document: lines as stored chunks, markers made when they were written, and what has gone wrong since.

A hash of a document decides what was planted: a marker that is missing, withdrawn, of another manifest or other rules, chunks lost,
changed, added or renamed. SQL reads the problem off the same points by itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import completion
from ..sources.tables import table

GENERATION, DIGEST = "g1", completion.digest_of({"embed_mode": "hash", "dense_dim": 256})


def records(spark, d):
    """(walked, markers, points)."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL AND text <> ''").select("doc_id", F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("source_rev"), F.md5("text").alias("sha256"), "text", (F.col("doc_id") % 17).alias("fate"))
    lines = docs.select("doc_id", "source_rev", "sha256", "fate", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    points = lines.select("doc_id", "source_rev", F.concat(F.lit("k"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("chunk_id"), "sha256", F.lit("v2").alias("rules_v"), "text", "i", "fate")
    good = completion.snapshot(points).select("doc_id", "source_rev", F.col("n").alias("expected"), "ids_digest", "content_digest")
    marked = docs.where("fate <> 1").select("doc_id", "source_rev", "sha256", "fate").join(good, ["doc_id", "source_rev"])
    marker = marked.select(
        F.lit(1).alias("turn"), "doc_id", "source_rev", F.lit(GENERATION).alias("generation"), F.when(F.col("fate") == 2, "old").otherwise(DIGEST).alias("manifest_digest"), "sha256",
        F.when(F.col("fate") == 3, "v1").otherwise("v2").alias("rules_v"), "expected", "ids_digest", "content_digest", F.lit(False).alias("withdrawn"),
    )
    withdrawn = marker.join(docs.where("fate = 4").select("doc_id"), "doc_id", "left_semi").withColumn("turn", F.lit(2)).withColumn("withdrawn", F.lit(True))
    # after the markers were written: chunks get lost, changed, renamed, or made of something else
    now = points.where("NOT (fate = 5 OR (fate = 6 AND i = 0))")
    now = now.withColumn("text", F.when((F.col("fate") == 7) & (F.col("i") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    now = now.withColumn("chunk_id", F.when((F.col("fate") == 8) & (F.col("i") == 0), F.lit("renamed")).otherwise(F.col("chunk_id")))
    now = now.withColumn("sha256", F.when((F.col("fate") == 9) & (F.col("i") == 0), F.lit("other")).otherwise(F.col("sha256"))).drop("i", "fate")
    residue = docs.where("fate = 10").select("doc_id", F.lit("gone").alias("source_rev"), F.lit("k").alias("chunk_id"), "sha256", F.lit("v2").alias("rules_v"), "text")
    walked = docs.select("doc_id", "source_rev", "sha256", F.lit("v2").alias("rules_v"))
    return walked, marker.unionByName(withdrawn), now.unionByName(residue)


def verify(spark, d):
    walked, markers, points = records(spark, d)
    return completion.verified(walked, markers, completion.snapshot(points), GENERATION, DIGEST)


def block(spark, d):
    """What blocks publication, by kind; revisions of every fortieth document are retired."""
    walked, markers, points = records(spark, d)
    stored = completion.snapshot(points)
    retired = walked.where("doc_id % 40 = 0").select("doc_id", "source_rev")
    found = completion.blockers(completion.verified(walked, markers, stored, GENERATION, DIGEST), markers, stored, GENERATION, DIGEST, retired)
    return found.groupBy("problem").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def snapshot(spark, d):
    return completion.snapshot(records(spark, d)[2]).select("doc_id", "source_rev", "n", F.size("shas").alias("shas"), "ids_digest", "content_digest")


#: How a document's wanted manifest departs from the stored one: every field by a number of its own.
_DRIFT = {name: 11 + 2 * k for k, name in enumerate((*completion.REEMBED, *completion.RECORD_ONLY))}


def manifests(spark, d):
    """Each document's stored manifest against the one wanted, field by field; some fields are missing on one side or on both."""
    docs = table(spark, d, "documents").select("doc_id")
    value = lambda name, n, wanted: F.when(F.col("doc_id") % (n + 1) == 1, None).otherwise(F.concat(F.lit(name), F.when(F.lit(wanted) & (F.col("doc_id") % n == 0), "!").otherwise("")))
    made = lambda wanted: F.create_map(*[x for name, n in _DRIFT.items() if not (wanted and name == "sparse_model") for x in (F.lit(name), value(name, n, wanted))])
    stored = F.map_filter(made(False), lambda k, v: k != "sparse_model")
    return docs.select("doc_id", completion.compared(stored, made(True)).alias("c")).select("doc_id", "c.outcome", F.array_join("c.fields", ",").alias("fields"))


QUERIES = {"gt13_manifest_compare": manifests, "sc11_snapshot": snapshot, "gt17_verify_docs": verify, "gt19_publish_blockers": block}

_DOCS = "docs AS (SELECT doc_id, 'r' || CAST(doc_id % 3 AS VARCHAR) AS source_rev, text, md5(text) AS sha256, doc_id % 17 AS fate FROM documents WHERE text <> '')"
_TOLD = f"""WITH {_DOCS}, lines AS (SELECT doc_id, fate, len(string_split(text, chr(10))) AS n FROM docs),
told AS (SELECT d.doc_id, d.source_rev, CASE WHEN fate IN (1, 4) THEN 'unmarked' WHEN fate = 2 THEN 'manifest' WHEN fate = 3 THEN 'marker' WHEN fate = 5 OR (fate = 6 AND n = 1) THEN 'no points' WHEN fate = 6 THEN 'count' WHEN fate = 9 THEN 'source' WHEN fate = 8 THEN 'ids' WHEN fate = 7 THEN 'content' END AS problem
  FROM docs d JOIN lines USING (doc_id, fate))"""
_STEPS = {name: n for name, n in _DRIFT.items() if name != "sparse_model"}
_CHANGED = ", ".join(f"CASE WHEN doc_id % {n + 1} <> 1 AND doc_id % {n} = 0 THEN '{name}' END" for name, n in _STEPS.items() if name in completion.REEMBED)
_NOTED = _STEPS["dense_query_prefix"]
ORACLES = {
    "gt13_manifest_compare": f"""SELECT doc_id, CASE WHEN fields <> '' THEN 'reembed_required' WHEN noted THEN 'record_only_drift' ELSE 'compatible' END AS outcome, CASE WHEN fields <> '' THEN fields WHEN noted THEN 'dense_query_prefix' ELSE '' END AS fields
        FROM (SELECT doc_id, array_to_string([x FOR x IN [{_CHANGED}] IF x IS NOT NULL], ',') AS fields, doc_id % {_NOTED + 1} <> 1 AND doc_id % {_NOTED} = 0 AS noted FROM documents)""",
    "gt17_verify_docs": f"{_TOLD} SELECT * FROM told",
    "gt19_publish_blockers": f"""{_TOLD}, every AS (SELECT * FROM told WHERE problem IS NOT NULL UNION ALL SELECT doc_id, 'gone', 'residue' FROM docs WHERE fate = 10 UNION ALL SELECT doc_id, source_rev, 'stale marker' FROM docs WHERE fate = 2)
        SELECT problem, count(*) AS n, min(doc_id) AS first_doc FROM every WHERE NOT (doc_id % 40 = 0 AND source_rev <> 'gone') GROUP BY problem""",
    "sc11_snapshot": f"""WITH {_DOCS}, lines AS (SELECT doc_id, source_rev, fate, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs),
        pts AS (SELECT doc_id, source_rev, CASE WHEN fate = 8 AND i = 0 THEN 'renamed' ELSE 'k' || lpad(CAST(i AS VARCHAR), 6, '0') END AS c, t || CASE WHEN fate = 7 AND i = 0 THEN '!' ELSE '' END AS t, fate = 9 AND i = 0 AS other FROM lines WHERE NOT (fate = 5 OR (fate = 6 AND i = 0)) UNION ALL SELECT doc_id, 'gone', 'k', text, false FROM docs WHERE fate = 10)
        SELECT doc_id, source_rev, count(*) AS n, count(DISTINCT other) AS shas, sha256(string_agg(c, chr(10) ORDER BY c)) AS ids_digest, sha256(string_agg(c || ' ' || sha256(t), chr(10) ORDER BY c)) AS content_digest FROM pts GROUP BY ALL""",
}
