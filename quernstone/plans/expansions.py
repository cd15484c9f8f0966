"""Expansion of hits by their neighbours, over chunks derived from every document's lines, with SQL written apart from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expansion
from ..sources.tables import table

CAP, BUDGET = 4, 8

#: Lines as chunks: sections of 2 to 6 lines, some of whose names come back, on pages of two or three, some without an end.
_LINES = """SELECT doc_id, i, 2 + doc_id % 5 AS size, (2 + doc_id % 3) AS per FROM lines"""
CHUNKS = f"""SELECT doc_id * 100000 + i AS chunk_id, doc_id AS rev, 'H' || CAST(CASE WHEN doc_id % 7 = 0 THEN floor(i / size) % 2 ELSE floor(i / size) END AS INT) AS section, CAST(i % size AS INT) AS ordinal,
    CAST(floor(i / per) AS INT) AS page_start, CASE WHEN (i + doc_id) % 23 > 0 THEN CAST(floor(i / per) AS INT) + CASE WHEN (i + doc_id) % 6 = 0 THEN 1 ELSE 0 END END AS page_end,
    CASE WHEN floor(i / 9) % 3 < 2 THEN 'P' END AS product, 'V' || CAST(CAST(floor(i / 17) AS INT) % 2 AS STRING) AS version, 'M' || CAST((i + doc_id) % 4 AS STRING) AS m FROM ({_LINES}) x"""
#: Two documents ask together; each brings its first, middle and last line and the one after the middle.
HITS = """SELECT CAST(floor(doc_id / 2) AS BIGINT) AS request, doc_id % 2 * 4 + k AS rank, doc_id * 100000 + CASE k WHEN 0 THEN floor(n / 2) WHEN 1 THEN least(n - 1, floor(n / 2) + 1) WHEN 2 THEN 0 ELSE n - 1 END AS chunk_id,
    CASE WHEN doc_id % 10 < 2 THEN 'P' END AS product, CASE WHEN doc_id % 6 < 2 THEN 'V0' END AS version, CAST(floor(doc_id / 2) % 3 AS INT) AS rule FROM sized CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks WHERE n > 0"""


def _records(spark, d):
    sized = table(spark, d, "documents").select("doc_id", F.least(F.size(F.split("text", "\n")), F.lit(99999)).alias("n")).where("n > 0")
    lines = sized.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    chunks = spark.sql(CHUNKS.replace("FROM lines", "FROM {lines}"), lines=lines).withColumn("ids", F.array("m"))
    hits = spark.sql(HITS.replace("FROM sized", "FROM {sized}"), sized=sized)
    named = F.when(F.col("rule") == 1, F.array(F.lit("M1"), F.lit("M2"))).when(F.col("rule") == 2, F.array(F.lit("M0")))
    return hits.withColumn("chunk_id", F.col("chunk_id").cast("long")).withColumn("named", named), chunks


def page_orders(spark, d):
    hits, chunks = _records(spark, d)
    rows = expansion.ordered(expansion.windows(hits, chunks))
    return rows.select("rev", "at", "chunk_id", "proven", F.when(F.col("proven"), F.col("led")).alias("led"))


def reading_runs(spark, d):
    found, _ = expansion.runs(*_records(spark, d), CAP)
    return found.select("request", "rank", "offset", "nth", "chunk_id")


def slots(spark, d):
    return expansion.expanded(*_records(spark, d), CAP, BUDGET)[0]


def outcomes(spark, d):
    return expansion.expanded(*_records(spark, d), CAP, BUDGET)[1]


QUERIES = {"wn14_page_order": page_orders, "wn13_reading_runs": reading_runs, "wn12_neighbour_slots": slots, "wn12_expand_outcome": outcomes}

_WITH = f"""WITH sized AS (SELECT doc_id, least(len(string_split(text, chr(10))), 99999) AS n FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(range(n)) AS i FROM sized), chunks AS (SELECT * REPLACE (CAST(chunk_id AS BIGINT) AS chunk_id) FROM ({CHUNKS}) c), hits AS (SELECT * REPLACE (CAST(chunk_id AS BIGINT) AS chunk_id) FROM ({HITS}) h),
win AS (SELECT DISTINCT c.rev, c.page_start AS w FROM hits JOIN chunks c USING (chunk_id)),
seen AS (SELECT w.w, c.* FROM win w JOIN chunks c ON c.rev = w.rev AND abs(c.page_start - w.w) <= 2),
small AS (SELECT *, min(ordinal) OVER (PARTITION BY rev, w, section, page_start) AS ord0 FROM seen QUALIFY count(*) OVER (PARTITION BY rev, w) <= 64),
sect AS (SELECT rev, w, section, count(*) > count(DISTINCT ordinal) AS bad, max(page_start) AS ps, max(page_end) AS pe, count(*) = count(page_end) AS closed FROM small GROUP BY ALL),
part AS (SELECT DISTINCT m.rev, m.w, m.page_start, m.section, m.ord0, s.bad, s.ps > m.page_start OR coalesce(s.pe > m.page_start, false) AS past, m.page_start < m.w + 2 AND s.closed AND s.pe <= m.page_start AS confined FROM small m JOIN sect s USING (rev, w, section)),
pg AS (SELECT rev, w, page_start, NOT bool_or(bad) AND count(*) FILTER (ord0 > 0) <= 1 AND (count(*) FILTER (ord0 = 0) <= 1 OR (count(*) FILTER (ord0 = 0) = 2 AND count(*) FILTER (ord0 = 0 AND past) = 1 AND count(*) FILTER (ord0 = 0 AND NOT past AND confined) = 1)) AS good FROM part GROUP BY ALL),
ord AS (SELECT m.*, p.good, CASE WHEN NOT p.good THEN false ELSE coalesce(lag(p.good) OVER o AND m.ordinal = CASE WHEN lag(m.section) OVER o = m.section THEN lag(m.ordinal) OVER o + 1 ELSE 0 END, false) END AS led, row_number() OVER o AS place
  FROM small m JOIN pg p USING (rev, w, page_start) JOIN part q USING (rev, w, page_start, section) WINDOW o AS (PARTITION BY m.rev, m.w ORDER BY m.page_start, CASE WHEN m.ord0 > 0 THEN 0 WHEN q.past THEN 2 ELSE 1 END, m.ordinal, m.chunk_id)),
base AS (SELECT h.*, o.rev, o.w, o.place, o.good, o.product AS own_p, o.version AS own_v FROM hits h JOIN ord o ON o.chunk_id = h.chunk_id AND o.w = o.page_start),
fits AS (SELECT b.request, b.rank, o.chunk_id, o.m, o.place - b.place AS k, o.good AND o.product IS NOT DISTINCT FROM b.own_p AND o.version IS NOT DISTINCT FROM b.own_v AND (b.product IS NULL OR b.product IS NOT DISTINCT FROM b.own_p) AND (b.version IS NULL OR b.version IS NOT DISTINCT FROM b.own_v) AND b.good AS scope,
  CASE WHEN o.place > b.place THEN o.led ELSE lead(o.led) OVER (PARTITION BY b.request, b.rank ORDER BY o.place) END AS link FROM base b JOIN ord o ON o.rev = b.rev AND o.w = b.w),
walk AS (SELECT *, bool_and(scope AND link) OVER (PARTITION BY request, rank, sign(k) ORDER BY abs(k)) AS ok FROM fits WHERE k <> 0),
run AS (SELECT *, row_number() OVER (PARTITION BY request, rank ORDER BY abs(k), k DESC) - 1 AS nth FROM walk WHERE ok AND abs(k) <= {CAP} QUALIFY nth < {CAP}),
named AS (SELECT r.*, x.rule, x.rule = 0 OR (x.rule = 1 AND r.m IN ('M1', 'M2')) OR (x.rule = 2 AND r.m = 'M0') AS carries FROM run r JOIN (SELECT DISTINCT request, rule FROM hits) x USING (request) ANTI JOIN hits h ON h.request = r.request AND h.chunk_id = r.chunk_id),
firsts AS (SELECT request, chunk_id, row_number() OVER (PARTITION BY request ORDER BY min(nth * 100 + rank)) AS slot FROM named WHERE carries GROUP BY request, chunk_id),
kept AS (SELECT n.request, n.rank, n.k AS "offset", n.chunk_id FROM named n JOIN firsts f USING (request, chunk_id) WHERE n.carries AND f.slot <= {BUDGET} QUALIFY row_number() OVER (PARTITION BY n.request, n.chunk_id ORDER BY n.nth, n.rank) = 1)
"""
ORACLES = {
    "wn14_page_order": _WITH + "SELECT rev, w AS at, chunk_id, good AS proven, CASE WHEN good THEN led END AS led FROM ord",
    "wn13_reading_runs": _WITH + 'SELECT request, rank, CAST(k AS BIGINT) AS "offset", nth, chunk_id FROM run',
    "wn12_neighbour_slots": _WITH + 'SELECT request, rank, CAST("offset" AS BIGINT) AS "offset", chunk_id, row_number() OVER (PARTITION BY request ORDER BY rank, "offset") AS place FROM kept',
    "wn12_expand_outcome": _WITH + f""", stops AS (SELECT h.request, sum(CASE WHEN coalesce(b.good, false) THEN (SELECT count(DISTINCT sign(k)) FROM walk w WHERE w.request = h.request AND w.rank = h.rank AND NOT w.ok AND abs(w.k) <= {CAP}) ELSE 2 END) AS stopped FROM hits h LEFT JOIN base b USING (request, rank) GROUP BY h.request),
  cuts AS (SELECT request, count(*) FILTER (carries AND slot > {BUDGET}) AS cut, count(*) FILTER (NOT carries) AS skipped FROM named LEFT JOIN firsts USING (request, chunk_id) GROUP BY request)
  SELECT s.request, coalesce(a.added, 0) AS added, coalesce(a.hits, 0) AS hits, CAST(s.stopped AS BIGINT) AS stopped, coalesce(c.cut, 0) AS cut, CASE WHEN s.request % 3 > 0 THEN coalesce(c.skipped, 0) END AS skipped
  FROM stops s LEFT JOIN (SELECT request, count(*) AS added, count(DISTINCT rank) AS hits FROM kept GROUP BY request) a USING (request) LEFT JOIN cuts c USING (request)""",
}
