"""Rules of functions/gold.py over derived records, with SQL written apart from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gold as X
from ..sources.tables import table


def eligible(spark, d):
    kind = F.expr("CASE doc_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'syntax' WHEN 2 THEN 'prose' END")
    classes = F.array(*map(F.lit, ("syntax", "concept", "message_id", "table")))
    return table(spark, d, "documents").select("doc_id", F.array_join(X.eligible_classes(F.expr("doc_id % 3 = 0"), kind, classes), ",").alias("classes"))


def arms(spark, d):
    """Turns of two arms from events, every seventh without scores, with metrics of eighths."""
    metric = lambda m, k: F.expr(f"CASE WHEN event_id % 7 > 0 THEN (event_id * {k} % 9) / 8D END").alias(m)
    made = [metric(m, k) for m, k in zip(X.RECALLS, (2, 3, 4, 5, 7), strict=True)]
    times = [F.expr("event_id * 13 % 997 / 4D").alias("retrieval_ms"), F.expr("CASE WHEN event_id % 5 > 0 THEN event_id * 17 % 991 / 4D END").alias("condense_ms")]
    return X.arm_summary(table(spark, d, "events").select(F.expr("CASE event_id % 2 WHEN 0 THEN 'literal' ELSE 'condensed' END").alias("arm"), *made, *times))


QUERIES = {"pf16_eligible_classes": eligible, "mx07_arm_summary": arms}


def _arms_sql() -> str:
    mean = lambda r, k: f"round((SELECT avg((event_id * {k} % 9) / 8.0) FROM s WHERE r = {r}), 3)"
    upper = lambda of: f"(SELECT round(v, 1) FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM ({of})) WHERE i = n // 2)"
    out = []
    for r, arm in ((0, "literal"), (1, "condensed")):
        out.append(f"(SELECT count(*) FROM s WHERE r = {r}) AS {arm}_n")
        out += [f'{mean(r, k)} AS "{arm}_{m}"' for m, k in (("recall@1", 2), ("recall@3", 3), ("recall@5", 4), ("recall@8", 5), ("mrr", 7))]
        out.append(f"{upper(f'SELECT event_id * 13 % 997 / 4.0 AS v FROM s WHERE r = {r}')} AS {arm}_p50_ms")
    out.append(f"{upper('SELECT event_id * 17 % 991 / 4.0 AS v FROM events WHERE event_id % 2 = 1 AND event_id % 5 > 0')} AS condense_p50_ms")
    out += [f'round({mean(1, k)} - {mean(0, k)}, 3) AS "delta_{m}"' for m, k in (("recall@1", 2), ("recall@5", 4), ("mrr", 7))]
    return f"WITH s AS (SELECT event_id, event_id % 2 AS r FROM events WHERE event_id % 7 > 0) SELECT {', '.join(out)}"


ORACLES = {
    "pf16_eligible_classes": """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'syntax,' ELSE '' END || 'concept' || CASE WHEN doc_id % 3 = 0 THEN ',message_id' ELSE '' END
        || CASE WHEN doc_id % 4 = 0 THEN ',table' ELSE '' END AS classes FROM documents""",
    "mx07_arm_summary": _arms_sql(),
}
