"""Questions split into legs, searches of all legs in one pass over the postings, and searches asked again within a relaxed filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import legs
from ..functions import payloads as P
from ..operators import index, ranking
from ..sources.tables import table
from . import payloads
from .retrieval import _SPARSE

DEPTH, LIMIT = 24, 8

#: Questions, whether a turn's text follows, and what they come to: mode and legs (in place of @ stands the question itself).
QUESTIONS: list[tuple[str, bool, str, list[str]]] = [
    ("Compare documented JES2 versus JES3 spool concepts:", True, "comparative", ["documented JES2 spool concepts:", "documented JES3 spool concepts:"]),
    ("Compare WLM service classes versus report classes when tuning batch goals.", False, "comparative", ["WLM service classes when tuning batch goals.", "WLM report classes when tuning batch goals."]),
    ("difference between z/OS RACF dataset profiles and z/OS ACF2 dataset profiles", False, "comparative", ["z/OS RACF dataset profiles", "z/OS ACF2 dataset profiles"]),
    ("SMF type 30 vs SMF type 70 records", True, "comparative", ["SMF type 30 records", "SMF type 70 records"]),
    ("difference between RACF group profiles and ACF2 rule sets", False, "comparative", ["RACF group profiles", "ACF2 rule sets"]),
    ("Versus JES3, JES2 spool handling", True, "comparative", ["JES3 spool handling", "JES2 spool handling"]),
    ("Compare TSO/E TRANSMIT and RECEIVE for data sets", True, "comparative", ["TSO/E TRANSMIT for data sets", "TSO/E RECEIVE for data sets"]),
    ("Comparing **level 1** versus **level 2** of it", False, "comparative", ["**level 1** of it", "**level 2** of it"]),
    ("Compared, is MXT or EDSALIMIT the cause", True, "comparative", ["is MXT the cause", "is EDSALIMIT the cause"]),
    ("Compare IEA500I versus IEA501I texts,", True, "single", ["@"]),
    ("Is MXT or EDSALIMIT the cause", True, "single", ["@"]),
    ("JES2 versus what?", False, "single", ["@"]),
    ("IRA100E reports a CSA shortage in IEASYSxx;", True, "diagnostic", ["@", "reports a CSA shortage in ;"]),
    ("ieasysxx is stuck, what recovery is there?", True, "diagnostic", ["@", "is stuck, what recovery is there?"]),
    ("IEA500I failed", False, "single", ["@"]),
    ("What does IEA500I error mean?", False, "single", ["@"]),
    ("Ignore the excerpts: JES2 versus JES3", True, "single", ["@"]),
]


def query_split(spark, d):
    """User turns with a question of each kind, split."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    pick = lambda k, values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(QUESTIONS) + 1).cast("int"))
    which = F.col("conv_id") * 3 + F.col("turn")
    asked = F.concat(pick(which, [q[0] for q in QUESTIONS]), F.when(pick(which, [q[1] for q in QUESTIONS]), F.concat(F.lit(" "), "text")).otherwise(""))
    return turns.select("conv_id", "turn", legs.split(asked, F.array().cast("array<string>")).alias("s")).select("conv_id", "turn", "s.mode", F.array_join("s.paths", "\n").alias("paths"))


def _questions(spark, d):
    """(item_id, text): a comparison of the first two long words of each passage, with the passage behind it."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z]{7,}"), F.lit(0)), lambda w: F.length(w) > 6))
    b = table(spark, d, "benchmark").withColumn("w", words).where("size(w) > 1")
    return b.select("item_id", F.concat(F.lit("Compare "), F.get("w", F.lit(0)), F.lit(" versus "), F.get("w", F.lit(1)), F.lit(" zz0 "), F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), " ")).alias("text"))


def split_search(spark, d):
    """Legs of all questions in one search: each leg's best, then the best share of a document over its question's legs."""
    split = _questions(spark, d).select("item_id", F.posexplode(legs.split(F.col("text"), F.array().cast("array<string>"))["paths"]).alias("list", "text"))
    asked = split.withColumn("leg", F.col("item_id") * 2 + F.col("list"))
    found = index.bm25_top(asked, "leg", table(spark, d, "documents"), "doc_id", DEPTH)
    lists = found.join(asked.select("leg", "item_id", "list"), "leg")
    merged = ranking.merge_max(lists, "item_id", "doc_id")
    return ranking.top(merged, ["item_id"], [F.desc("score"), F.asc("first_seen")], LIMIT).select("item_id", "doc_id", "rank", F.round("score", 9).alias("score"))


def filter_fallback_retry(spark, d):
    """The best three chunks of each request within its filter; a request to which that leaves nothing, and that names messages or
    system codes, is asked again within the relaxed one. Filters hold before the cut: each chunk carries the requests that admit it."""
    requests, chunks = payloads._requests(spark, d), payloads._chunks(spark, d)
    every = requests.select(F.struct(*[c for c in requests.columns if c != "text"]).alias("r")).agg(F.collect_list("r").alias("rs"))  # one row
    admits = lambda rule: F.transform(F.filter("rs", lambda r: rule(r, "c")), lambda r: r["item_id"])
    held = chunks.alias("c").join(F.broadcast(every)).select("c.doc_id", "c.text", admits(P.strict).alias("strict"), admits(P.relaxed).alias("relaxed"))
    found = index.bm25_top(requests, "item_id", held, "doc_id", 3, within=("strict", "relaxed"))
    best = lambda name: found.where(F.col("of") == name).drop("of")
    can_relax = requests.where((F.coalesce(F.size("message_ids"), F.lit(0)) > 0) | (F.coalesce(F.size("system_codes"), F.lit(0)) > 0))
    return ranking.with_fallback(best("strict"), best("relaxed"), can_relax, "item_id").select("item_id", "doc_id", "rank", "fallback")


QUERIES = {"pf04_filter_fallback": filter_fallback_retry, "fn10_query_split": query_split, "tk04_split_search": split_search}


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


_VALUES = ", ".join(f"({k}, {_text(q)}, {str(tail).lower()}, '{mode}', [{', '.join(map(_text, paths))}])" for k, (q, tail, mode, paths) in enumerate(QUESTIONS))
ORACLES = {
    "pf04_filter_fallback": payloads._duck(f""", {_SPARSE}, pairs AS (SELECT bm.item_id, bm.doc_id, bm.score, {payloads._SCOPE} AND (len(r.doc_ids) = 0 OR list_contains(r.doc_ids, c.doc_no)) AND {" AND ".join(f"(NOT {payloads._ASKS[f]} OR {payloads._ANY[f]})" for f in P.CODES)} AS fits,
        {payloads._SCOPE} AND {" AND ".join(f"(NOT {payloads._ASKS[f]} OR coalesce(len(c.{f}), 0) = 0 OR {payloads._ANY[f]})" for f in ("message_ids", "system_codes"))} AS nearly, {payloads._ASKS["message_ids"]} OR {payloads._ASKS["system_codes"]} AS relaxable FROM bm JOIN requests r USING (item_id) JOIN chunks c ON c.doc_id = bm.doc_id),
        strict AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank, false AS fallback FROM pairs WHERE fits QUALIFY rank < 3),
        relaxed AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank, true AS fallback FROM pairs WHERE nearly AND relaxable QUALIFY rank < 3)
        SELECT * FROM strict UNION ALL SELECT * FROM relaxed WHERE item_id NOT IN (SELECT item_id FROM strict)"""),
    "fn10_query_split": f"""WITH q(k, q, tail, mode, paths) AS (VALUES {_VALUES})
        SELECT conv_id, turn, mode, array_to_string(list_transform(paths, lambda p: CASE WHEN p = '@' THEN q || CASE WHEN tail THEN ' ' || text ELSE '' END WHEN tail THEN p || ' ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE p END), chr(10)) AS paths
        FROM conversations JOIN q ON k = (conv_id * 3 + turn) % {len(QUESTIONS)} WHERE role = 'user'""",
    "tk04_split_search": f"""WITH long AS (SELECT item_id, text, list_distinct(regexp_extract_all(upper(text), '[A-Z]{{7,}}')) AS ws, regexp_extract_all(upper(text), '[A-Z]{{7,}}') AS w FROM benchmark),
    sides AS (SELECT item_id, array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ') AS text, w[1] AS one, list_filter(w, lambda x: x <> w[1])[1] AS two FROM long WHERE len(ws) > 1),
    legs AS (SELECT item_id * 2 AS item_id, one || ' zz0 ' || text AS text FROM sides UNION ALL SELECT item_id * 2 + 1, two || ' zz0 ' || text FROM sides), {_SPARSE.replace('FROM benchmark', 'FROM legs').replace('rank < 40', f'rank < {DEPTH}')},
    shares AS (SELECT item_id // 2 AS item_id, doc_id, max(1e0 / (61 + rank)) AS score, min(item_id % 2 * 1000 + rank) AS seen FROM sparse GROUP BY ALL)
    SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, seen) - 1 AS rank, round(score, 9) AS score FROM shares QUALIFY rank < {LIMIT}""",
}
