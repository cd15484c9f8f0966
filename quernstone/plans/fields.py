"""Rules of functions/fields.py over derived records, with SQL written apart from them."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from ..functions import fields as X
from ..sources.tables import table
from . import payloads

_LABELS = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '3-' || CAST(doc_id % 90 AS STRING) WHEN 1 THEN chr(CAST(65 + doc_id % 26 AS INT)) || '-9' WHEN 2 THEN CAST(doc_id % 100 AS STRING) ELSE 'x' || CAST(doc_id % 9 AS STRING) END AS before,
    CASE doc_id % 4 WHEN 0 THEN '3-' || CAST(doc_id * 7 % 90 AS STRING) WHEN 1 THEN chr(CAST(65 + doc_id * 3 % 26 AS INT)) || '-1' WHEN 2 THEN CAST(doc_id * 11 % 100 AS STRING) ELSE 'y' || CAST(doc_id * 5 % 9 AS STRING) END AS after FROM documents"""


def cleaned(spark, d):
    odd = F.regexp_replace("text", "a", "​\t")
    return table(spark, d, "documents").select("doc_id", X.clean_field(odd, 80).alias("field"))


def prices(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_price(F.col("text")).alias("price"))


def romans(spark, d):
    """Short strings of roman and other letters, with their value."""
    letters = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.substring(F.lit("ivxlcdmi"), (F.col("doc_id") / F.pow(F.lit(8), k)).cast("int") % 8 + 1, F.lit(1)))
    made = F.substring(F.array_join(letters, ""), F.lit(1), F.col("doc_id").cast("int") % 4 + 1)
    return table(spark, d, "documents").select(made.alias("token")).distinct().select("token", X.roman_value(F.col("token")).cast("long").alias("value"))


def advances(spark, d):
    labels = payloads._derived(spark, d, _LABELS, "documents")
    return labels.select("doc_id", X.label_advances(F.col("before"), F.col("after")).alias("advances"))


def violations(spark, d):
    """Eight hits of each request, in rank, with a barred document and three barred messages."""
    asked = payloads._requests(spark, d).select("item_id", F.col("message_ids").alias("asked"), F.posexplode(F.expr("transform(sequence(0, 7), k -> item_id * 3 + k)")).alias("at", "doc_id"))
    hits = asked.join(payloads._chunks(spark, d).select("doc_id", "doc_no", "message_ids"), "doc_id")
    barred = F.array(F.concat(F.lit("D"), ((F.col("item_id") * 3 + 2) % 50).cast("string")))
    messages = F.array(*[F.lit(x) for x in ("IEA100I", "IEA103I", "IEA104I")])
    found = F.explode(X.must_not(F.col("at") + 1, F.col("doc_no"), F.col("message_ids"), barred, messages, F.col("asked"))).alias("v")
    return hits.select("item_id", (F.col("at") + 1).alias("rank"), found).select("item_id", "rank", "v.type", "v.value")


def jobs(spark, d):
    line = F.expr("CASE event_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'JOB1  JOB' || string(event_id) WHEN 2 THEN 'A J' || string(event_id) || ' U OUTPUT A RC=0000 3 spool' WHEN 3 THEN 'B J1  U ACTIVE rc=4 CC=12' ELSE 'C J2 U INPUT' END")
    return table(spark, d, "events").select("event_id", X.job_line(line).alias("j")).select("event_id", *[f"j.{c}" for c in ("name", "job_id", "owner", "status", "return_code")], F.col("j.raw").isNotNull().alias("kept"))


def positions(spark, d):
    rows = table(spark, d, "documents").select("text", F.explode(F.slice(F.split(F.translate("text", ascii_lowercase, ascii_uppercase), " "), 20, 30)).alias("gold"))
    return rows.where("gold <> ''").groupBy(X.gold_position(F.col("text"), F.col("gold"), 200).alias("position")).agg(F.count("*").alias("n"))


def structure(spark, d):
    count = lambda m, r: F.sum((F.col("event_id") % m == r).cast("long"))
    runs = table(spark, d, "events").groupBy((F.col("event_id") / 4).cast("long").alias("run")).agg(count(17, 0).alias("s"), count(13, 1).alias("e"), count(11, 2).alias("f"), count(7, 3).alias("r"))
    return runs.select("run", X.structure_gate(*map(F.col, "sefr")).alias("g")).select("run", "g.verdict", F.array_join("g.reasons", "; ").alias("reasons"))


def inferred(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 5 > 0 THEN transform(sequence(1, int(doc_id % 3) + 1), k -> int((doc_id + k * 4) % 9) - 1) END").alias("i"), F.expr("transform(sequence(1, 3), k -> (doc_id * k) % 6)").alias("e"), F.expr("transform(sequence(1, 5), k -> (doc_id + k) % 8)").alias("h"))
    return rows.select("doc_id", X.off_gold(F.col("i"), F.col("e"), F.col("h")).alias("off"))


QUERIES = {
    "fn13_clean_field": cleaned,
    "fn56_token_price": prices,
    "fn38_roman_value": romans,
    "fn38_label_advances": advances,
    "pf10_must_not": violations,
    "mx05_job_lines": jobs,
    "mx06_gold_positions": positions,
    "gt05_structure_gate": structure,
    "gt39_off_gold": inferred,
}

#: All numerals by their digits, and none else: a numeral is looked up, not computed.
_NUMERALS = """numerals AS (SELECT ['', 'm', 'mm', 'mmm'][n // 1000 + 1] || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1]
    || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] AS token, n FROM range(1, 4000) t(n))"""

ORACLES = {
    "fn13_clean_field": r"""WITH t AS (SELECT doc_id, trim(regexp_replace(replace(substr(replace(text, 'a', chr(8203) || chr(9)), 1, 640), chr(8203), ''), '\s+', ' ', 'g')) AS f FROM documents)
        SELECT doc_id, CASE WHEN length(f) > 80 THEN rtrim(substr(f, 1, 79)) || '…' ELSE f END AS field FROM t""",
    "fn56_token_price": r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS x FROM documents),
        a AS (SELECT doc_id, sum(CASE WHEN length(x) <= 15 AND regexp_full_match(x, '[A-Za-z][a-z]*') THEN (length(x) + 1) // 2 ELSE length(x) END) AS n FROM w GROUP BY doc_id)
        SELECT doc_id, (coalesce(n, 0) + len(regexp_extract_all(text, '\n|[ \t]{2,}')) + strlen(regexp_replace(text, '[\sA-Za-z0-9]', '', 'g')))::BIGINT AS price FROM documents LEFT JOIN a USING (doc_id) WHERE text IS NOT NULL
        UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL""",
    "fn38_roman_value": f"""WITH {_NUMERALS}, made AS (SELECT DISTINCT substr('ivxlcdmi'[doc_id % 8 + 1] || 'ivxlcdmi'[doc_id // 8 % 8 + 1] || 'ivxlcdmi'[doc_id // 64 % 8 + 1] || 'ivxlcdmi'[doc_id // 512 % 8 + 1], 1, (doc_id % 4 + 1)::INT) AS token FROM documents)
        SELECT token, n AS value FROM made LEFT JOIN numerals USING (token)""",
    "fn38_label_advances": f"""WITH {_NUMERALS}, l AS ({_LABELS})
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id * 7 % 90 > doc_id % 90 WHEN 2 THEN doc_id * 11 % 100 > doc_id % 100
        WHEN 1 THEN CASE WHEN before[1] = after[1] THEN false WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN b.n > a.n ELSE after[1] > before[1] END ELSE true END AS advances
        FROM l LEFT JOIN numerals a ON a.token = lower(before[1]) LEFT JOIN numerals b ON b.token = lower(after[1])""",
    "pf10_must_not": payloads._duck("""SELECT item_id, rank, type, value FROM (SELECT r.item_id, (c.doc_id - 3 * r.item_id + 1)::INT AS rank, unnest(['doc_id', 'message_id']) AS type,
        unnest([CASE WHEN c.doc_no = 'D' || (r.item_id * 3 + 2) % 50 THEN c.doc_no END, CASE WHEN NOT list_has_any(c.message_ids, r.message_ids) THEN nullif(array_to_string(list_filter(['IEA100I', 'IEA103I', 'IEA104I'], lambda m: list_contains(c.message_ids, m)), ','), '') END]) AS value
        FROM requests r JOIN chunks c ON c.doc_id BETWEEN 3 * r.item_id AND 3 * r.item_id + 4) WHERE value IS NOT NULL"""),
    "mx05_job_lines": """SELECT event_id, CASE k WHEN 2 THEN 'A' WHEN 3 THEN 'B' WHEN 4 THEN 'C' END AS name, CASE k WHEN 2 THEN 'J' || event_id WHEN 3 THEN 'J1' WHEN 4 THEN 'J2' END AS job_id, CASE WHEN k > 1 THEN 'U' END AS owner,
        CASE k WHEN 2 THEN 'OUTPUT' WHEN 3 THEN 'ACTIVE' WHEN 4 THEN 'INPUT' END AS status, CASE k WHEN 2 THEN '0000' WHEN 3 THEN '12' END AS return_code, k > 0 AS kept FROM (SELECT event_id, event_id % 5 AS k FROM events)""",
    "mx06_gold_positions": f"""WITH g AS (SELECT text, unnest(string_split(translate(text, '{ascii_lowercase}', '{ascii_uppercase}'), ' ')[20:49]) AS gold FROM documents)
        SELECT CASE WHEN NOT contains(lower(text), lower(gold)) THEN 'not_in_history' WHEN strpos(lower(text), lower(gold)) + length(gold) - 1 <= 200 THEN 'before_cut' ELSE 'after_cut' END AS position, count(*) AS n FROM g WHERE gold <> '' GROUP BY ALL""",
    "gt05_structure_gate": """WITH c AS (SELECT event_id // 4 AS run, count(*) FILTER (event_id % 17 = 0) AS s, count(*) FILTER (event_id % 13 = 1) AS e, count(*) FILTER (event_id % 11 = 2) AS f, count(*) FILTER (event_id % 7 = 3) AS r FROM events GROUP BY ALL)
        SELECT run, CASE WHEN s + e + f + r > 0 THEN 'hold' ELSE 'pass' END AS verdict, concat_ws('; ', CASE WHEN s > 0 THEN s || ' structural failure(s)' END, CASE WHEN e > 0 THEN e || ' request error(s)' END,
        CASE WHEN f > 0 THEN f || ' faithfulness judge error(s)' END, CASE WHEN r > 0 THEN r || ' relevance judge error(s)' END) AS reasons FROM c""",
    "gt39_off_gold": """WITH p AS (SELECT doc_id, unnest(range(1, doc_id % 3 + 2)) AS k FROM documents WHERE doc_id % 5 > 0), i AS (SELECT doc_id, (doc_id + k * 4) % 9 - 1 AS i FROM p)
        SELECT doc_id, coalesce(NOT met, false) AS off FROM documents LEFT JOIN (SELECT doc_id, bool_or(i BETWEEN 1 AND 5 AND ((doc_id + i) % 8) IN (doc_id % 6, doc_id * 2 % 6, doc_id * 3 % 6)) AS met FROM i GROUP BY doc_id) USING (doc_id)""",
}
