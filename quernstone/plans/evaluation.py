"""Statistics, acceptance, gates and breakdowns. Labels are outcomes, documents' languages their classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from ..sources.tables import table
from .dialect import registered


def percentiles_nearest(q):
    """Nearest-rank percentiles by return flag; missing values don't count."""
    return f"SELECT l_returnflag, count(l_quantity) AS n, {q.disc('l_extendedprice', 0.5)} AS p50, {q.disc('l_extendedprice', 0.95)} AS p95, {q.disc('l_quantity', 0.9)} AS q90 FROM lineitem GROUP BY l_returnflag"


def percentiles_linear(q):
    return f"SELECT event_type, round({q.cont('value', 0.5)}, 6) AS p50, round({q.cont('value', 0.95)}, 6) AS p95, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY event_type"


def percentiles_rounded(q):
    """The percentile at the half-even rounded index, per event type."""
    at = f"CAST({q.even('0.95 * (n - 1)', 0)} AS INT)"
    return f"SELECT event_type, max(CASE WHEN r = {at} THEN value END) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) e GROUP BY event_type"


def distribution(q):
    """Count, ends and nearest-rank percentiles, with a flag for few values."""
    return f"SELECT source, count(n_chars) AS n, min(n_chars) AS lo, {q.disc('n_chars', 0.5)} AS p50, {q.disc('n_chars', 0.95)} AS p95, max(n_chars) AS hi, count(n_chars) < 5 AS low_n FROM documents GROUP BY source"


def _wilson(z: float, lower: bool) -> str:
    p, n = "(good / n)", "n"
    sign = "-" if lower else "+"
    return f"({p} + {z * z} / (2 * {n}) {sign} {z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4 * {n} * {n}))) / (1 + {z * z} / {n})"


def wilson(q):
    """One-sided 95 % bounds of the share of good outcomes by language."""
    z = 1.6448536269514722
    return f"SELECT lang, n, good, round({_wilson(z, True)}, 9) AS lo, round({_wilson(z, False)}, 9) AS hi FROM (SELECT lang, CAST(count(*) AS DOUBLE) AS n, CAST(sum(quality) AS DOUBLE) AS good FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY lang) s"


def acceptance(q):
    """Every case in three repeats; a missing outcome is a failure. Passed by the majority of a case's repeats."""
    reps = "SELECT 1 AS rep UNION ALL SELECT 2 UNION ALL SELECT 3"
    return f"""WITH cases AS (SELECT doc_id, lang FROM documents), table_of AS (SELECT c.doc_id, lang, rep, coalesce(l.quality = 1 AND l.toxic = 0 AND (c.doc_id + rep) % 4 <> 0, false) AS passed, l.doc_id IS NULL AS missing FROM cases c CROSS JOIN ({reps}) r LEFT JOIN labels l ON c.doc_id = l.doc_id),
     means AS (SELECT doc_id, lang, avg(CASE WHEN passed THEN 1e0 ELSE 0e0 END) AS mean, min(CASE WHEN passed THEN 1 ELSE 0 END) <> max(CASE WHEN passed THEN 1 ELSE 0 END) AS flips, max(CASE WHEN missing THEN 1 ELSE 0 END) AS missing FROM table_of GROUP BY doc_id, lang)
     SELECT lang, count(*) AS cases, sum(CASE WHEN mean > 0.5 THEN 1 ELSE 0 END) AS passed, round(avg(CASE WHEN flips THEN 1e0 ELSE 0e0 END), 9) AS flip_rate, sum(missing) AS missing, CASE WHEN count(*) - sum(missing) < 30 THEN 'insufficient' WHEN avg(mean) >= 0.3 THEN 'pass' ELSE 'fail' END AS verdict FROM means GROUP BY lang"""


def diagnostics(q):
    """Rates over all requests, and over those that were completed."""
    return """SELECT lang, round(avg(CASE WHEN l.quality = 1 THEN 1e0 ELSE 0e0 END), 9) AS of_all, round(avg(CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 1 THEN 1e0 ELSE 0e0 END END), 9) AS of_completed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang"""


def outcome_integrity(q):
    """Outcomes of unknown cases and repeats of one case."""
    return "SELECT 'unknown_case' AS problem, count(*) AS n FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id WHERE d.doc_id IS NULL UNION ALL SELECT 'duplicate', count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1) x UNION ALL SELECT 'out_of_range', count(*) FROM labels WHERE quality NOT IN (0, 1)"


def critical_result(q):
    """Tri-state safety result: unassessed stays null."""
    return "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN false WHEN l.quality = 1 THEN true END AS safe FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def repeat_spread(q):
    """Spread of each user's values over event types, and how many users' verdicts flip."""
    return "SELECT event_type, count(*) AS n, min(m) AS lo, max(m) AS hi, round(max(m) - min(m), 6) AS range, sum(CASE WHEN flips THEN 1 ELSE 0 END) AS flips FROM (SELECT event_type, user_id, round(avg(value), 6) AS m, min(CASE WHEN value > 50 THEN 1 ELSE 0 END) <> max(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS flips FROM events GROUP BY event_type, user_id) u GROUP BY event_type"


def repeat_summary(q):
    """Means over repeats, and nothing where a repeat lacks the metric."""
    return "SELECT user_id, sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) AS faults, round(CASE WHEN count(v) = count(*) THEN avg(v) END, 6) AS rate FROM (SELECT user_id, value, CASE WHEN value >= 1 THEN value END AS v FROM events) e GROUP BY user_id"


def answer_summary(q):
    """Rates by class with missing signals left out of the denominators."""
    return "SELECT coalesce(lang, 'all') AS class, count(*) AS n, count(l.quality) AS judged, round(avg(l.quality), 6) AS pass_rate, round(avg(l.toxic), 6) AS fault_rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY GROUPING SETS ((), (lang))"


def measurement(q):
    """Pass rate, truncation and length percentiles by language."""
    return f"SELECT lang, round(avg(CASE WHEN n_chars > 3000 THEN 1e0 ELSE 0e0 END), 6) AS truncated, {q.disc('n_chars', 0.5)} AS p50, {q.disc('n_chars', 0.95)} AS p95, count(*) AS n FROM documents GROUP BY lang"


def stratified(q):
    """Round-robin over classes, each in id order: a sample is a prefix of this order."""
    return "SELECT doc_id, lang, depth, row_number() OVER (PARTITION BY depth ORDER BY lang) AS seat FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS depth FROM documents) d"


def switch_pairs(q):
    """For each document of a source the next one in another language, wrapping around."""
    return """WITH placed AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
     runs AS (SELECT *, lead(lang) OVER (PARTITION BY source ORDER BY i) AS after FROM placed), ends AS (SELECT *, min(CASE WHEN after <> lang THEN i + 1 END) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM runs),
     firsts AS (SELECT p.source, max(CASE WHEN i = 1 THEN lang END) AS lang1, min(CASE WHEN i > 1 AND lang <> l1 THEN i END) AS change FROM (SELECT *, first_value(lang) OVER (PARTITION BY source ORDER BY i) AS l1 FROM placed) p GROUP BY p.source)
     SELECT e.doc_id, t.doc_id AS partner FROM ends e JOIN firsts f ON e.source = f.source JOIN placed t ON t.source = e.source AND t.i = coalesce(e.nxt, CASE WHEN e.lang <> f.lang1 THEN 1 ELSE f.change END)"""


def _neighbours(docs: DataFrame) -> DataFrame:
    """Documents in blocks of neighbours, each with its place in its source's part of the block and the next document there that changes the language.

    Blocks are ranges of (source, doc_id), as many as shuffle partitions and numbered in that order, so that a large source is many. Their bounds
    come from a sample that another reading would draw anew; so the rows are stored."""
    spark = docs.sparkSession
    order = [F.asc_nulls_last("doc_id"), "lang"]
    cut = docs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "source", order[0]).withColumn("block", F.spark_partition_id())
    w, back = Window.partitionBy("source", "block").orderBy(*order), Window.partitionBy("source", "block").orderBy(F.desc("i"))
    # a struct tells a document without an id from no document
    change = F.when(F.col("lang") != F.lag("lang").over(w), F.struct("doc_id"))
    placed = cut.select("*", F.row_number().over(w).alias("i"), F.lead(F.lit(1)).over(w).isNull().alias("ends"), change.alias("change"))
    nxt = F.last("change", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    return shared.stored(placed.withColumn("nxt", nxt).drop("change"), shared.folder(spark))


def switch_partners(spark, d):
    """switch_pairs without gathering a source: within blocks first, then from block to block, where a source has a row for each."""
    placed = _neighbours(table(spark, d, "documents").where("source IS NOT NULL").select("source", "doc_id", "lang"))
    opens = lambda c: F.max(F.when(F.col("i") == 1, F.col(c)))
    blocks = placed.where("i = 1 OR ends").withColumn("doc", F.struct("doc_id")).groupBy("source", "block").agg(opens("doc").alias("doc"), opens("lang").alias("lang"), opens("nxt").alias("inner"), F.max(F.when(F.col("ends"), F.col("lang"))).alias("end"))
    chain, back = Window.partitionBy("source").orderBy("block"), Window.partitionBy("source").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    heads = blocks.select("source", "block", F.when(F.col("lang") != F.lag("end").over(chain), F.col("doc")).otherwise(F.col("inner")).alias("head"))
    later = heads.select("source", "block", F.last("head", ignorenulls=True).over(back).alias("later"))
    # where no change follows: the source's first document, or the first whose language isn't that one's
    openings = blocks.groupBy("source").agg(F.min_by("doc", "block").alias("doc1"), F.min_by("lang", "block").alias("lang1"))
    least = placed.groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
    others = least.join(openings, "source").where("lang <> lang1").groupBy("source").agg(F.struct(F.min("doc_id").alias("doc_id")).alias("other"))
    wraps = later.join(openings.join(others, "source", "left"), "source")
    partner = F.coalesce("nxt", "later", F.when(F.col("lang") != F.col("lang1"), F.col("doc1")).otherwise(F.col("other")))
    return placed.join(wraps, ["source", "block"]).select("doc_id", partner.alias("partner")).where("partner IS NOT NULL").select("doc_id", F.col("partner.doc_id").alias("partner"))


def switch_states(q):
    """What became of each case between two repeats: kept, lost, gained, neither or unknown."""
    return """SELECT state, count(*) AS n FROM (SELECT CASE WHEN a.quality IS NULL OR b.quality IS NULL THEN 'unknown' WHEN a.quality = 1 AND b.quality = 1 THEN 'kept' WHEN a.quality = 1 THEN 'lost' WHEN b.quality = 1 THEN 'gained' ELSE 'neither' END AS state
     FROM documents d LEFT JOIN labels a ON a.doc_id = d.doc_id LEFT JOIN labels b ON b.doc_id = d.doc_id + 1) s GROUP BY state"""


def why_mode(q):
    """The first cause that fits, most specific first; a missing signal never says no."""
    return f"""SELECT mode, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'error' WHEN value < 1 THEN 'zero_hits' WHEN k >= 50 AND k % 2 = 0 THEN 'cited_explicit' WHEN k >= 50 THEN 'cited_inferred' WHEN value > 60 AND k < 20 THEN 'truncated_before_cites' WHEN value > 60 AND k IS NULL THEN 'unknown' WHEN k % 7 = 0 THEN 'fabricated_unmapped' WHEN k IS NULL THEN 'unknown' ELSE 'absent' END AS mode
     FROM (SELECT event_type, value, CAST({q.json('props', 'k')} AS INT) AS k FROM events) e) m GROUP BY mode"""


def taxonomy(q):
    """Counts of outcome classes and their causes, with subtotals."""
    return """SELECT coalesce(row_class, 'all') AS row_class, coalesce(cause, 'all') AS cause, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS row_class, CASE WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 500 THEN 'short' ELSE 'other' END AS cause FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) t GROUP BY ROLLUP (row_class, cause)"""


def quality_bands(q):
    """pass, borderline or fail of each language against the mean of all."""
    return """SELECT lang, CASE WHEN r >= ref THEN 'pass' WHEN r >= ref - 0.05 THEN 'borderline' ELSE 'fail' END AS band FROM (SELECT lang, round(avg(quality), 9) AS r FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY lang) a CROSS JOIN (SELECT round(avg(quality), 9) AS ref FROM labels) b"""


def baseline_gate(q):
    """Metrics of this half of the events against the other: ratio floors, with the reasons for a hold."""
    half = lambda n: f"SELECT event_type AS metric, avg(value) AS v, count(*) AS n FROM events WHERE event_id % 2 = {n} GROUP BY event_type"
    return f"SELECT coalesce(c.metric, b.metric) AS metric, round(c.v / b.v, 6) AS ratio, CASE WHEN c.metric IS NULL THEN 'missing' WHEN c.v < 0.95 * b.v THEN 'below floor' WHEN c.n < 0.5 * b.n THEN 'coverage' ELSE 'ok' END AS reason FROM ({half(0)}) c FULL OUTER JOIN ({half(1)}) b ON c.metric = b.metric"


def performance_gate(q):
    """95th percentiles by stage within three times the baseline's, and no missing times."""
    return f"SELECT p_type AS stage, {q.disc('p_retailprice', 0.95)} AS p95, {q.disc('p_retailprice', 0.95)} <= 3 * {q.disc('p_retailprice', 0.5)} AND count(*) = count(p_retailprice) AS ok FROM part GROUP BY p_type"


def report_compare(q):
    """Differences between two reports by key, and which of them are regressions."""
    side = lambda s: f"SELECT o_orderpriority AS k, round(avg(o_totalprice), 4) AS v FROM orders WHERE o_orderstatus = '{s}' GROUP BY o_orderpriority"
    return f"SELECT coalesce(a.k, b.k) AS k, round(b.v - a.v, 3) AS delta, coalesce(b.v < 0.99 * a.v, true) AS regression FROM ({side('F')}) a FULL OUTER JOIN ({side('O')}) b ON a.k = b.k"


def coverage_states(q):
    """all, some, none or not_applicable: how much of a customer's expected statuses their orders show."""
    return """SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'not_applicable' WHEN count(DISTINCT o_orderstatus) = 3 THEN 'all' WHEN max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 THEN 'some' ELSE 'none' END AS state FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"""


def turn_breakdown(q):
    """Lengths and repeats by turn and role."""
    return "SELECT turn, role, count(*) AS n, round(avg(length(text)), 4) AS chars, sum(CASE WHEN length(text) > 500 THEN 1 ELSE 0 END) AS long_ones FROM conversations GROUP BY turn, role"


def citation_precision(q):
    """Precision and recall of the parts an order lists against the parts its customer's other orders hold."""
    return """WITH cited AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), gold AS (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'),
     joined AS (SELECT o.o_orderkey, count(DISTINCT c.l_partkey) AS cited, count(DISTINCT CASE WHEN g.l_partkey IS NOT NULL THEN c.l_partkey END) AS hit FROM orders o JOIN cited c ON c.l_orderkey = o.o_orderkey LEFT JOIN gold g ON g.o_custkey = o.o_custkey AND g.l_partkey = c.l_partkey GROUP BY o.o_orderkey),
     wanted AS (SELECT o_custkey, count(*) AS n FROM gold GROUP BY o_custkey)
     SELECT j.o_orderkey, round(CAST(hit AS DOUBLE) / nullif(cited, 0), 6) AS precision_, round(CAST(hit AS DOUBLE) / nullif(n, 0), 6) AS recall FROM joined j JOIN orders o ON o.o_orderkey = j.o_orderkey LEFT JOIN wanted w ON w.o_custkey = o.o_custkey"""


def decode_rate(q):
    """Tokens a second where counts and times are valid."""
    return "SELECT event_id, CASE WHEN value > 1 AND user_id > 0 THEN round(user_id * 1000e0 / (value * 100), 2) END AS tps FROM events"


def sample_digest(q):
    """An order-sensitive digest of each source's ids, block by block."""
    return f"SELECT source, {q.idiv('doc_id', '1000')} AS block, {q.sha256(q.join(q.listed('CAST(doc_id AS STRING)', 'doc_id'), ','))} AS digest FROM documents GROUP BY source, {q.idiv('doc_id', '1000')}"


def noise_floor(q):
    """Best latency and worst error count over repeats."""
    return "SELECT event_type, min(value) AS best, max(CASE WHEN value > 90 THEN 1 ELSE 0 END) AS any_slow, max(user_id) AS peak FROM events GROUP BY event_type"


def requested_per_class(q):
    """An even split of a hundred over the classes, the first ones taking the rest."""
    return f"SELECT lang, CAST({q.idiv('100', 'n')} + CASE WHEN r <= 100 % n THEN 1 ELSE 0 END AS BIGINT) AS wanted FROM (SELECT lang, row_number() OVER (ORDER BY lang) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT lang FROM documents) l) m"


def completeness(q):
    """Parts answered of parts asked, over rows that asked any."""
    return "SELECT lang, count(*) AS rows_, round(avg(CASE WHEN n_chars > 100 THEN CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END END), 6) AS complete FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NOT NULL GROUP BY lang"


def pool_validation(q):
    """Recorded ranks must run without gaps; orders whose line numbers don't."""
    return "SELECT l_orderkey, count(*) AS n, max(l_linenumber) AS last, count(DISTINCT l_linenumber) = count(*) AND max(l_linenumber) = count(*) AS whole FROM lineitem GROUP BY l_orderkey"


QUERIES, ORACLES = registered(
    {
        "ag22_percentiles_nearest": percentiles_nearest,
        "ag23_percentiles_linear": percentiles_linear,
        "ag24_percentiles_rounded": percentiles_rounded,
        "ag26_distribution": distribution,
        "ag29_wilson": wilson,
        "ag31_acceptance": acceptance,
        "gt08_diagnostics": diagnostics,
        "gt11_outcome_integrity": outcome_integrity,
        "gt09_critical_result": critical_result,
        "ag21_repeat_spread": repeat_spread,
        "ag18_repeat_summary": repeat_summary,
        "ag16_answer_summary": answer_summary,
        "ag20_measurement": measurement,
        "wn19_stratified": stratified,
        "jn20_switch_pairs": switch_pairs,
        "jn21_switch_states": switch_states,
        "fn60_why_mode": why_mode,
        "ag36_taxonomy": taxonomy,
        "gt04_quality_bands": quality_bands,
        "gt01_baseline_gate": baseline_gate,
        "gt03_performance_gate": performance_gate,
        "gt30_report_compare": report_compare,
        "gt36_coverage_states": coverage_states,
        "gt32_turn_breakdown": turn_breakdown,
        "st08_citation_precision": citation_precision,
        "gt41_decode_rate": decode_rate,
        "gt40_sample_digest": sample_digest,
        "ag42_noise_floor": noise_floor,
        "ag45_requested_per_class": requested_per_class,
        "ag40_completeness": completeness,
        "gt25_pool_validation": pool_validation,
    }
)

QUERIES |= {"jn20_switch_pairs": switch_partners}
