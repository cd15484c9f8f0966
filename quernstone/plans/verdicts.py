"""Intervals, promotion and acceptance over records derived from the labels and events, with SQL written apart from the rules."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import gates, resampling
from ..sources.tables import table

#: Resamples here, so that SQL can follow; and the seed.
RESAMPLES, SEED = 200, 11
REPEATS, CONFIDENCE = 3, 0.95

#: Two runs of a venue's entries, made of the labelled documents: values rise in some runs, fall in a class, or stay.
_PAIRS = """SELECT doc_id % 6 AS run, doc_id AS entry, 'c' || CAST(CAST(floor(doc_id / 6) AS INT) % 3 AS STRING) AS class,
    CASE WHEN doc_id % 7 < 3 THEN 1e0 ELSE 0e0 END AS b1, CASE WHEN doc_id % 7 < 4 THEN 1e0 ELSE 0e0 END AS b5, 1e0 / (1 + doc_id % 7) AS bm,
    CASE WHEN doc_id % 7 < CASE WHEN doc_id % 6 = 2 AND floor(doc_id / 6) % 3 = 1 THEN 1 ELSE 4 END THEN 1e0 ELSE 0e0 END AS c1,
    CASE WHEN doc_id % 7 < CASE WHEN doc_id % 6 IN (0, 1, 5) THEN 6 ELSE 4 END THEN 1e0 ELSE 0e0 END AS c5,
    1e0 / (1 + doc_id % CASE WHEN doc_id % 6 IN (1, 2) THEN 4 ELSE 7 END) AS cm, CASE WHEN doc_id % 6 = 3 AND doc_id % 11 = 0 THEN false WHEN doc_id % 5 = 0 THEN true END AS trap FROM labels"""


def _pairs(spark, d):
    return spark.sql(_PAIRS.replace("FROM labels", "FROM {labels}"), labels=table(spark, d, "labels").select("doc_id").distinct())


def _sides(spark, d):
    """(candidate, baseline, recorded): run 4 has no baseline, run 5's baseline was made of one entry more."""
    p = _pairs(spark, d)
    candidate = p.select("run", "entry", "class", F.col("c1").alias("recall_1"), F.col("c5").alias("recall_5"), F.col("cm").alias("mrr"), "trap")
    baseline = p.where("run <> 4").select("run", "entry", "class", F.col("b1").alias("recall_1"), F.col("b5").alias("recall_5"), F.col("bm").alias("mrr"))
    recorded = p.where("run <> 0").groupBy("run").agg((F.count("*") + F.when(F.col("run") == 5, 1).otherwise(0)).alias("entries"))
    return candidate, baseline, recorded


def _rounded(df, by):
    return df.select(by, "n", *[F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")])


def quality_interval(spark, d):
    """The mean quality of each source's labelled documents, with its interval."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("source", "doc_id", "quality")
    return _rounded(resampling.interval(rows, "source", "doc_id", "quality", RESAMPLES, SEED), "source")


def paired_interval(spark, d):
    """The mean change of a metric in each run, its interval, and whether that lies above zero."""
    candidate, baseline, _ = _sides(spark, d)
    deltas = gates.paired(candidate, baseline).withColumn("g", F.concat_ws("|", F.col("run").cast("string"), "metric"))
    return _rounded(resampling.interval(deltas, "g", "entry", "delta", RESAMPLES, SEED), "g").withColumn("above", F.col("lo") > 0)


def promotion(spark, d):
    return gates.promotion(*_sides(spark, d), RESAMPLES, SEED).select("run", "verdict", F.array_join("reasons", "; ").alias("reasons"))


#: Sets of cases made of the events, three in a row a case's repeats, of which one in 29 is missing in some sets.
_CASES = """SELECT DISTINCT CAST(floor(event_id / 3) AS BIGINT) % 7 AS "set", CAST(floor(event_id / 3) AS BIGINT) AS "case", CASE WHEN floor(event_id / 3) % 5 = 0 THEN 'abstain' ELSE 'answer' END AS expected, 'c' || CAST(CAST(floor(event_id / 3) AS INT) % 4 AS STRING) AS class,
    CASE WHEN floor(event_id / 3) % 7 < 3 AND floor(event_id / 3) % 6 = 0 THEN 'p1' END AS probe, CASE WHEN floor(event_id / 3) % 12 = 0 THEN 'answer' WHEN floor(event_id / 3) % 18 = 0 THEN 'refusal' ELSE 'timeout' END AS probe_expects FROM events"""
_SEEN = """SELECT CAST(floor(event_id / 3) AS BIGINT) % 7 AS "set", CAST(floor(event_id / 3) AS BIGINT) AS "case", CAST(event_id % 3 + 1 AS INT) AS "repeat", CASE WHEN event_id % 31 = 0 THEN 'missing' ELSE 'scored' END AS status,
    event_id % 37 > 0 AND NOT (floor(event_id / 3) % 6 = 0 AND floor(event_id / 3) % 12 > 0 AND floor(event_id / 3) % 18 > 0) AS completed, event_id % 41 = 0 OR floor(event_id / 3) % 5 = 0 AS refused, CASE WHEN event_id % 101 = 0 THEN 1 WHEN event_id % 103 = 0 THEN 2 ELSE 0 END AS failures,
    CASE WHEN floor(event_id / 3) % 7 <> 1 OR event_id % 9 > 0 THEN floor(event_id / 3) % 7 <> 2 OR event_id % 19 > 0 END AS critical_safe, user_id % 9 > 0 AS useful, user_id % 11 > 0 AS supported, CASE WHEN user_id % 13 > 0 THEN true END AS traceable,
    CASE WHEN floor(event_id / 3) % 5 = 0 THEN event_id % 8 > 0 END AS appropriate_abstention, CASE WHEN event_id % 23 > 0 THEN event_id % 53 = 0 END AS fabricated, event_id % 4 > 0 AS evidence_supplied FROM events WHERE floor(event_id / 3) % 7 < 5 OR event_id % 29 > 0"""
CRITERIA = [
    ("answers", "answer_pass", "answer", ">=", 0.6, "wilson_lower", 10), ("abstains", "abstain_pass", "abstain", ">=", 0.9, "point", 10), ("refusals", "false_refusal_rate", "answer", "<=", 0.05, "wilson_upper", 10),
    ("completes", "completion_rate", "all", ">=", 0.8, "point", 1), ("evidence", "evidence_supplied_rate", "answer:c1", ">=", 0.7, "wilson_lower", 5), ("fabricates", "fabrication_count", "abstain", "<=", 5.0, "point", 1),
    ("critical", "critical_failures", "all", "<=", 400.0, "point", 1), ("size", "case_count", "all:c2", ">=", 3.0, "point", 1), ("flips", "flip_rate", "answer", "<=", 0.8, "point", 10**6), ("none", "answer_pass", "answer:c9", ">=", 0.1, "wilson_lower", 0),
]
_FIELDS = "id string, metric string, scope string, op string, threshold double, statistic string, min_n int"


def _every(spark, d):
    events = table(spark, d, "events")
    made = lambda q: spark.sql(q.replace("FROM events", "FROM {events}").replace('"', "`"), events=events)
    listed = F.expr("CASE failures WHEN 0 THEN CAST(array() AS ARRAY<STRING>) WHEN 1 THEN array('p1') ELSE array('p2', 'p3') END")
    return gates.cells(made(_CASES), made(_SEEN).withColumn("critical_failures", listed), REPEATS)


def _criteria(spark, d):
    return gates.accepted(_every(spark, d), spark.createDataFrame(CRITERIA, _FIELDS), REPEATS, CONFIDENCE, True)


def criteria(spark, d):
    return _criteria(spark, d).select("set", "id", "n", F.round("value", 4).alias("value"), F.round("bound", 4).alias("bound"), "status")


def acceptance(spark, d):
    return gates.acceptance(_every(spark, d), _criteria(spark, d), REPEATS)


def case_intervals(spark, d):
    """The mean of a set's cases over their repeats, resampled by cases, with whole places of the sorted means as bounds."""
    by_case = _every(spark, d).where("expected = 'answer'").groupBy("set", "case").agg(F.avg("answer_pass").alias("mean_of"))
    return _rounded(resampling.interval(by_case, "set", "case", "mean_of", RESAMPLES, 367, 1 - CONFIDENCE, nearest=True), "set")


QUERIES = {
    "ag27_mean_interval": quality_interval,
    "ag28_paired_interval": paired_interval,
    "ag30_case_interval": case_intervals,
    "gt02_promotion": promotion,
    "ag31_criteria": criteria,
    "gt07_acceptance": acceptance,
}

_P = f"p AS ({_PAIRS.replace('FROM labels', 'FROM (SELECT DISTINCT doc_id FROM labels)')})"
_DELTAS = "SELECT run || '|recall_5' AS g, entry AS k, c5 - b5 AS v FROM p WHERE run <> 4 UNION ALL SELECT run || '|mrr', entry, cm - bm FROM p WHERE run <> 4"
_CI = f"{_P}, {resampling.sql(_DELTAS, RESAMPLES, SEED, resampling.ALPHA)}"
_SHOW = "n, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi"
_Z = NormalDist().inv_cdf(CONFIDENCE)
_LISTED = ", ".join(f"('{i}', '{m}', '{s}', '{o}', {t}::DOUBLE, '{x}', {n})" for i, m, s, o, t, x, n in CRITERIA)
_TABLE = f"""cases AS ({_CASES}), seen AS ({_SEEN}), crit(id, metric, scope, op, threshold, statistic, min_n) AS (VALUES {_LISTED}),
slots AS (SELECT c.*, r.r AS rep, s.* EXCLUDE ("set", "case", "repeat"), coalesce(s.status = 'scored', false) AS ok FROM cases c CROSS JOIN (SELECT unnest([1, 2, 3]) AS r) r LEFT JOIN seen s ON s."case" = c."case" AND s."repeat" = r.r),
safe AS (SELECT *, CASE WHEN NOT ok OR critical_safe IS NULL THEN NULL WHEN NOT critical_safe OR failures > 0 THEN false WHEN probe_expects = 'answer' THEN completed AND NOT refused
  WHEN probe_expects = 'refusal' THEN completed AND refused AND coalesce(appropriate_abstention, false) AND coalesce(NOT fabricated, false) ELSE NOT completed AND NOT refused END AS crit_ok FROM slots),
done AS (SELECT *, ok AND completed AND failures = 0 AND (probe IS NULL OR coalesce(crit_ok, false)) AND CASE WHEN expected = 'answer' THEN NOT refused AND useful AND supported AND coalesce(traceable, false) ELSE coalesce(appropriate_abstention, false) AND coalesce(NOT fabricated, false) END AS pass FROM safe),
long AS (SELECT "set", "case", expected, class, pass, m.metric, CASE m.metric WHEN 'answer_pass' THEN pass::INT WHEN 'abstain_pass' THEN pass::INT WHEN 'completion_rate' THEN (ok AND completed)::INT WHEN 'false_refusal_rate' THEN (ok AND completed AND refused)::INT
  WHEN 'evidence_supplied_rate' THEN (ok AND evidence_supplied)::INT WHEN 'fabrication_count' THEN (ok AND coalesce(fabricated, false))::INT
  WHEN 'critical_failures' THEN coalesce(failures, 0) + (status IS NOT NULL AND probe IS NOT NULL AND coalesce(NOT crit_ok, false) AND coalesce(failures, 0) <> 1)::INT END AS v FROM done CROSS JOIN (SELECT DISTINCT metric FROM crit) m),
byc AS (SELECT "set", "case", expected, class, metric, sum(v) AS s, count(DISTINCT pass) > 1 AS flips FROM long GROUP BY ALL),
hit AS (SELECT b.*, c.* EXCLUDE (metric), c.statistic <> 'point' AND c.metric IN ('answer_pass', 'abstain_pass', 'completion_rate', 'false_refusal_rate', 'evidence_supplied_rate') AS red FROM byc b JOIN crit c ON c.metric = b.metric AND (split_part(scope, ':', 1) IN ('all', expected)) AND split_part(scope, ':', 2) IN ('', class)),
summed AS (SELECT "set", id, count(*) AS n, avg(CASE WHEN red THEN (2 * s > 3)::INT ELSE s / 3.0::DOUBLE END) AS rate, sum(s) AS total, avg(flips::INT) AS flip FROM hit GROUP BY ALL),
valued AS (SELECT s0."set", c.*, coalesce(s.n, 0) AS n, CASE WHEN metric = 'case_count' THEN coalesce(s.n, 0)::DOUBLE WHEN coalesce(s.n, 0) < min_n THEN NULL WHEN metric = 'flip_rate' THEN flip WHEN metric IN ('fabrication_count', 'critical_failures') THEN total::DOUBLE ELSE rate END AS value
  FROM (SELECT DISTINCT "set" FROM cases) s0 CROSS JOIN crit c LEFT JOIN summed s ON s."set" = s0."set" AND s.id = c.id),
bounded AS (SELECT *, CASE WHEN statistic = 'point' THEN value WHEN n > 0 THEN (value + {_Z**2} / (2 * n) + CASE statistic WHEN 'wilson_lower' THEN -1 ELSE 1 END * {_Z} * sqrt(value * (1 - value) / n + {_Z**2} / (4.0 * n * n))) / (1 + {_Z**2} / n) END AS bound FROM valued),
told AS (SELECT *, CASE WHEN bound IS NULL THEN 'insufficient' WHEN CASE op WHEN '>=' THEN bound >= threshold - 1e-9 ELSE bound <= threshold + 1e-9 END THEN 'pass' ELSE 'fail' END AS status FROM bounded)"""
ORACLES = {
    "ag27_mean_interval": f"WITH {resampling.sql('SELECT source AS g, doc_id AS k, quality AS v FROM labels JOIN documents USING (doc_id)', RESAMPLES, SEED, resampling.ALPHA)} SELECT g AS source, {_SHOW} FROM ci",
    "ag28_paired_interval": f"WITH {_CI} SELECT g, {_SHOW}, lo > 0 AS above FROM ci",
    "ag30_case_interval": f"""WITH {_TABLE}, {resampling.sql('SELECT "set" AS g, "case" AS k, avg(pass::INT) AS v FROM done WHERE expected = ' + "'answer'" + ' GROUP BY "set", "case"', RESAMPLES, 367, 1 - CONFIDENCE, True)} SELECT g AS "set", {_SHOW} FROM ci""",
    "gt02_promotion": f"""WITH {_CI}, cls AS (SELECT run, class, m.m AS k, round_even(avg(CASE m.m WHEN 0 THEN b1 WHEN 1 THEN b5 ELSE bm END), 4) - round_even(avg(CASE m.m WHEN 0 THEN c1 WHEN 1 THEN c5 ELSE cm END), 4) > 0.05 AS fell FROM p CROSS JOIN (SELECT unnest([0, 1, 2]) AS m) m WHERE run <> 4 GROUP BY ALL),
        runs AS (SELECT run, string_agg(CASE WHEN NOT trap THEN entry::VARCHAR END, ', ' ORDER BY entry::VARCHAR) AS failed FROM p GROUP BY run), up AS (SELECT split_part(g, '|', 1)::BIGINT AS run, split_part(g, '|', 2) AS metric FROM ci WHERE lo > 0),
        all_why AS (SELECT run, 0 AS o, '' AS c, 'trap failures: ' || failed AS why FROM runs WHERE failed IS NOT NULL UNION ALL SELECT run, 1, class || k, 'class regression: ' || class || ' ' || ['recall_1', 'recall_5', 'mrr'][k + 1] FROM cls WHERE fell
          UNION ALL SELECT run, 2, '', 'no primary metric improved beyond its interval' FROM runs WHERE run NOT IN (SELECT run FROM up)),
        why AS (SELECT run, string_agg(why, '; ' ORDER BY o, c) AS why FROM all_why GROUP BY run), better AS (SELECT run, string_agg(metric, '; ' ORDER BY metric DESC) AS why FROM up GROUP BY run)
        SELECT r.run, CASE WHEN r.run = 4 THEN 'baseline' WHEN r.run = 5 OR w.why IS NOT NULL THEN 'hold' ELSE 'merge' END AS verdict, CASE WHEN r.run = 4 THEN 'no baseline recorded' WHEN r.run = 5 THEN 'another number of entries' ELSE coalesce(w.why, b.why) END AS reasons
        FROM runs r LEFT JOIN why w USING (run) LEFT JOIN better b USING (run)""",
    "ag31_criteria": f'WITH {_TABLE} SELECT "set", id, n, round_even(value, 4) AS value, round_even(bound, 4) AS bound, status FROM told',
    "gt07_acceptance": f"""WITH {_TABLE}, more AS (SELECT "set", id, status FROM told UNION ALL SELECT "set", 'outcomes_complete', CASE WHEN bool_and(status IS NOT NULL) THEN 'pass' ELSE 'insufficient' END FROM done GROUP BY "set"
        UNION ALL SELECT "set", 'critical_probes_assessed', CASE WHEN count(*) FILTER (probe IS NOT NULL AND crit_ok IS NULL) > 0 THEN 'insufficient' WHEN count(*) FILTER (probe IS NOT NULL AND NOT crit_ok) > 0 THEN 'fail' ELSE 'pass' END FROM done GROUP BY "set")
        SELECT "set", CASE WHEN bool_or(status = 'fail') THEN 'rejected' WHEN bool_or(status = 'insufficient') THEN 'incomplete' ELSE 'accepted' END AS verdict, coalesce(string_agg(CASE WHEN status = 'fail' THEN id END, ',' ORDER BY id), '') AS failing, coalesce(string_agg(CASE WHEN status = 'insufficient' THEN id END, ',' ORDER BY id), '') AS lacking FROM more GROUP BY "set\"""",
}
