"""Rules over stored records, applied to records of their own shape that are derived from the given tables.

What is derived (RECORDS) is said once for both engines; the rules are written apart: columns here, SQL of its own below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import payloads as P
from ..operators import records
from ..sources.tables import table

_SPARK = {"a": lambda *x: f"array({', '.join(x)})", "none": "CAST(array() AS ARRAY<STRING>)"}
_DUCK = {"a": lambda *x: f"[{', '.join(x)}]", "none": "CAST([] AS VARCHAR[])"}


def _n(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _chunks_sql(e: dict) -> str:
    codes = f"CASE WHEN doc_id % 4 = 1 THEN {e['none']} WHEN doc_id % 4 = 2 THEN {e['a']("'IEA' || " + _n('100 + doc_id % 7') + " || 'I'")} WHEN doc_id % 4 = 3 THEN {e['a']("'IEA' || " + _n('100 + doc_id % 5') + " || 'I'", "'DFS' || " + _n('300 + doc_id % 3'))} END"
    return f"""SELECT doc_id, 'D' || {_n('doc_id % 50')} AS doc_no, source, CAST(floor(doc_id / 20) AS BIGINT) AS page_start, CASE WHEN doc_id % 9 > 0 THEN {_n('doc_id % 11')} END AS page_label,
    ' ' || source || ' Guide' AS title, CASE WHEN doc_id % 3 = 0 THEN source || ' Guide ' ELSE source || ' Guide > ' || coalesce(lang, '') END AS heading_path,
    CASE WHEN doc_id % 5 > 0 THEN 'P' || {_n('doc_id % 4')} END AS product, CASE WHEN doc_id % 6 > 0 THEN 'V' || {_n('doc_id % 2')} END AS version,
    {codes} AS message_ids, CASE WHEN doc_id % 3 = 0 THEN {e['none']} WHEN doc_id % 3 = 2 THEN {e['a']("'S0C' || " + _n('doc_id % 5'))} END AS system_codes,
    CASE WHEN doc_id % 5 < 3 THEN {e['none']} ELSE {e['a']("'IEASYS0' || " + _n('doc_id % 4'))} END AS members, text FROM documents"""


def _requests_sql(e: dict) -> str:
    return f"""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'P1' WHEN item_id % 3 = 1 THEN '' END AS product, CASE WHEN item_id % 4 = 0 THEN 'V1' END AS version,
    CASE WHEN item_id % 11 = 0 THEN {e['a']("'D' || " + _n('item_id % 50'), "'D7'")} ELSE {e['none']} END AS doc_ids,
    CASE WHEN item_id % 2 = 0 THEN {e['a']("'IEA' || " + _n('100 + item_id % 7') + " || 'I'", "'IEA104I'")} ELSE {e['none']} END AS message_ids,
    CASE WHEN item_id % 7 = 0 THEN {e['a']("'IEASYS01'")} ELSE {e['none']} END AS members, CASE WHEN item_id % 5 = 0 THEN {e['a']("'S0C' || " + _n('item_id % 5'))} END AS system_codes, text FROM benchmark"""


_OUTCOMES = """SELECT event_id, CAST(event_id % 40 AS BIGINT) AS case_id, CASE WHEN event_id % 8 = 0 THEN 'abstain' ELSE 'answer' END AS expected, CASE WHEN event_id % 6 = 0 THEN 'probe' END AS critical_probe,
    CASE WHEN event_id % 12 = 0 THEN 'refusal' WHEN event_id % 6 = 0 THEN 'answer' WHEN event_id % 9 = 0 THEN 'timeout' END AS critical_expected, CASE WHEN event_id % 13 = 0 THEN 'missing' ELSE 'scored' END AS status,
    event_id % 17 > 0 AS completed, event_id % 10 = 0 OR event_id % 8 = 0 AS refused, CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END AS critical_failures, CASE WHEN event_id % 7 > 0 THEN event_id % 5 > 0 END AS critical_safe,
    CASE WHEN event_id % 11 > 0 THEN user_id % 3 > 0 END AS useful, user_id % 7 > 0 AS supported, CASE WHEN user_id % 4 > 0 THEN true END AS traceable,
    CASE WHEN event_id % 8 = 0 THEN event_id % 16 = 0 END AS appropriate_abstention, CASE WHEN event_id % 5 > 0 THEN event_id % 3 = 0 END AS fabricated FROM events"""


def _derived(spark, d, sql: str, *names: str) -> DataFrame:
    for name in names:
        table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def _chunks(spark, d):
    return _derived(spark, d, _chunks_sql(_SPARK), "documents")


def _requests(spark, d):
    return _derived(spark, d, _requests_sql(_SPARK), "benchmark")


def _admitting(rule):
    def run(spark, d):
        found = records.admitted(_requests(spark, d).drop("text"), "item_id", _chunks(spark, d).drop("text"), rule)
        return found.groupBy("r.item_id").agg(F.count("*").alias("n"), F.min("c.doc_id").alias("first_doc"))

    return run


def same_scope(spark, d):
    """Neighbouring pages' chunks that share their scope, by source."""
    c = _chunks(spark, d).select("source", "page_start", "doc_id", "product", "version")
    after = c.select("source", (F.col("page_start") - 1).alias("page_start"), "doc_id", "product", "version")
    pairs = c.alias("a").join(after.alias("b"), ["source", "page_start"])
    return pairs.groupBy("source").agg(F.count("*").alias("pairs"), F.sum(P.same_scope("a", "b").cast("long")).alias("same"))


def chunk_fields(spark, d):
    return _chunks(spark, d).select("doc_id", P.leading_title(F.col("page_start"), F.col("title"), F.col("heading_path")).alias("leading"))


def page_keys(spark, d):
    page = F.when(F.col("doc_id") % 7 > 0, F.col("page_start"))
    return _chunks(spark, d).groupBy("doc_no", P.page_key(page, F.coalesce("page_label", F.lit(""))).alias("page_key")).agg(F.count("*").alias("n"))


def edges(spark, d):
    c = _chunks(spark, d)
    first, last = (records.edge_page(c, ["source"], "page_start", "page_label", lower) for lower in (True, False))
    return first.join(last.withColumnsRenamed({"page": "last_page", "label": "last_label"}), "source")


def plain_labels(spark, d):
    label = F.concat(F.expr("CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'p. ' WHEN 2 THEN 'SA22-7592-0' WHEN 3 THEN 'a,b ' WHEN 4 THEN '\t 1-' ELSE 'Chapter of some length over the bound ' END"), F.expr("CAST(doc_id % 90 AS STRING)"))
    return _chunks(spark, d).select("doc_id", P.plain_label(label).alias("label"))


def heading_paths(spark, d):
    titles = F.slice(F.split("text", " "), 1, 12)
    return _chunks(spark, d).select("doc_id", P.heading_path(F.transform(titles, lambda t: F.repeat(t, 12))).alias("path"))


def contexts(spark, d):
    return _chunks(spark, d).select("doc_id", P.normal_context(F.col("text"), 120).alias("context"))


def line_kinds(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    return lines.groupBy("doc_id").agg(F.sum(P.is_prose(F.col("line")).cast("long")).alias("prose"), F.sum(P.is_hex(F.col("line")).cast("long")).alias("hex"))


def run_copies(spark, d):
    c = _chunks(spark, d).select("doc_id", F.split("text", " ").alias("tokens"))
    needle = F.slice("tokens", F.greatest(F.size("tokens") - 3, F.lit(1)), 3)
    shown = c.select("doc_id", P.contains_run(F.col("tokens"), needle).alias("own"), P.contains_run(F.slice("tokens", 1, 40), F.reverse(needle)).alias("turned"))
    return shown


def states(spark, d):
    e = _derived(spark, d, "SELECT *, CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 9 = 0 THEN 'length' ELSE 'stop' END AS finish FROM events", "events")
    i = F.col("event_id")
    state = P.verification_state(i % 29 == 0, F.col("finish"), i % 11 == 0, i % 5 > 0, i % 2 == 0, i % 4, i % 7 == 0)
    return e.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def no_hits(spark, d):
    terms = F.concat("message_ids", "doc_ids", "members", F.expr("slice(split(text, ' '), 1, CAST(item_id % 5 AS INT))"))
    return _requests(spark, d).select("item_id", P.no_hits_message(terms).alias("message"))


def skip_gate(spark, d):
    """Documents held against a ledger of earlier runs, of which one in four has another content or other rules."""
    held = F.struct(F.expr("CASE WHEN doc_id % 4 = 0 THEN md5('old') WHEN doc_id % 10 > 0 THEN md5(text) END").alias("sha"), F.expr("CASE WHEN doc_id % 3 > 0 THEN 'r2' END").alias("rules"), F.expr("CASE doc_id % 5 WHEN 0 THEN 'dry' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' ELSE 'upserted' END").alias("status"))
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("sha"), held.alias("r"))
    gate = P.skips(F.col("r.sha"), F.col("sha"), F.col("r.rules"), F.lit("r2"), F.col("r.status"), F.col("doc_id") % 2 == 0, F.col("doc_id") % 13 == 0)
    return docs.select("doc_id", gate.alias("skip"))


def cases_in_scope(spark, d):
    o = _derived(spark, d, _OUTCOMES, "events")
    scopes = F.explode(F.array(*[F.lit(x) for x in ("all", "answer", "abstain:c1", "all:c2", "answer:c0")]))
    held = o.select("expected", F.concat(F.lit("c"), F.expr("CAST(case_id % 3 AS STRING)")).alias("class"), scopes.alias("scope"))
    return held.groupBy("scope").agg(F.sum(P.case_in_scope(F.col("scope"), F.col("expected"), F.col("class")).cast("long")).alias("n"))


def passes(spark, d):
    return _derived(spark, d, _OUTCOMES, "events").alias("o").select("event_id", P.case_passes("o").alias("passed"))


def means(spark, d):
    """Three events make a case's repeats; half as many cases again have no outcome at all."""
    o = _derived(spark, d, _OUTCOMES, "events").alias("o")
    runs = o.select(F.expr("event_id div 3").alias("case_id"), (F.col("event_id") % 3 + 1).cast("int").alias("turn"), P.case_passes("o").cast("double").alias("cell"))
    cases = table(spark, d, "events").select(F.expr("event_id div 2").alias("case_id")).distinct()
    return records.case_means(cases, 3, runs, "case_id", "turn", F.col("cell")).select("case_id", F.round("mean", 6).alias("mean"))


def overlaps(spark, d):
    """Even documents as released cases, odd ones as tuning queries: released texts that the tuning set has too."""
    texts = table(spark, d, "documents").select("doc_id", F.lower(P.collapsed(F.col("text"))).alias("q"))
    return texts.where("doc_id % 2 = 0").join(texts.where("doc_id % 2 = 1").select("q").distinct(), "q", "left_semi").select("doc_id")


def repeated_lines(spark, d):
    return records.duplicates(table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")), F.lower(F.col("line")))


def catalog_against_markers(spark, d):
    c = _chunks(spark, d)
    return records.set_differences(c.select("doc_no", "source"), c.where("doc_id % 31 > 0").select("doc_no", "source")).groupBy("doc_no", "source", "side").agg(F.count("*").alias("n"))


def nearest(spark, d):
    c = _chunks(spark, d).select("source", "page_start", "doc_id")
    near = c.withColumn("hit", F.explode(F.array(*[F.col("page_start") + k for k in (-3, -2, -1, 1, 2, 3)])))
    hits = c.where("doc_id % 100 = 0").select("source", F.col("page_start").alias("hit"), F.col("doc_id").alias("hit_id"))
    rows = near.join(hits, ["source", "hit"]).withColumn("offset", (F.col("page_start") - F.col("hit")).cast("int"))
    one = rows.groupBy("hit_id", "offset").agg(F.min("doc_id").alias("doc_id"))
    return records.nearest_first(one, "hit_id", "offset", 4).select("hit_id", "place", "offset", "doc_id")


def page_of_sources(spark, d):
    return records.keyset_page(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 25, 40).select("doc_id", "source", "nth", "more")


def refused(spark, d):
    c = _chunks(spark, d)
    asked = c.where("doc_id % 3 = 0").select("doc_no", "source")
    return records.refused_removals(asked, c.where("doc_id % 2 = 0"), ["doc_no", "source"])


def vendors(spark, d):
    path = F.concat(F.expr("CASE doc_id % 7 WHEN 0 THEN 'CA/' WHEN 1 THEN 'x\\\\ca-7/' WHEN 2 THEN 'IBM/bmc/' WHEN 3 THEN 'Red-Hat/' WHEN 4 THEN 'africa/' WHEN 5 THEN 'redhat_' ELSE '' END"), F.col("source"))
    return table(spark, d, "documents").groupBy(P.vendor(path).alias("vendor")).agg(F.count("*").alias("n"))


def pins(spark, d):
    from . import retrieval

    sparse = retrieval._sparse(spark, d)
    fused = retrieval.ranking.fused_order(retrieval._fused(spark, d, facts=(), sparse=sparse), "item_id", 24)
    return records.pinned(fused, sparse, "item_id", "doc_id", 8)


QUERIES = {
    "pf01_strict_filter": _admitting(P.strict),
    "pf02_scope_filter": _admitting(P.in_scope),
    "pf03_relaxed_filter": _admitting(P.relaxed),
    "pf14_carries_identifier": _admitting(P.carries),
    "pf15_same_scope": same_scope,
    "pf08_leading_title": chunk_fields,
    "wn06_page_key": page_keys,
    "ag07_edge_pages": edges,
    "fn14_plain_label": plain_labels,
    "fn37_heading_path": heading_paths,
    "fn41_context": contexts,
    "fn45_line_kinds": line_kinds,
    "fn64_token_run": run_copies,
    "fn49_verification_state": states,
    "fn70_no_hits_message": no_hits,
    "pf11_skip_gate": skip_gate,
    "pf13_case_scope": cases_in_scope,
    "gt10_case_pass": passes,
    "jn10_case_means": means,
    "jn15_tuning_overlap": overlaps,
    "st12_duplicates": repeated_lines,
    "st05_set_differences": catalog_against_markers,
    "wn16_nearest_first": nearest,
    "tk11_keyset_page": page_of_sources,
    "gt23_refused_removals": refused,
    "sc03_vendor": vendors,
    "wn10_pinned_hits": pins,
}


def _duck(own: str) -> str:
    return f"WITH chunks AS ({_chunks_sql(_DUCK)}), requests AS ({_requests_sql(_DUCK)}), outcomes AS ({_OUTCOMES}) {own}"


_SCOPE = " AND ".join(f"(coalesce(r.{f}, '') = '' OR coalesce(r.{f} = c.{f}, false))" for f in ("product", "version"))
_ANY = {f: f"coalesce(list_has_any(r.{f}, c.{f}), false)" for f in P.CODES}
_ASKS = {f: f"coalesce(len(r.{f}), 0) > 0" for f in P.CODES}
_COUNTED = "SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM requests r JOIN chunks c ON {} GROUP BY item_id"
_TOKENS = r"list_filter(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' '), lambda t: t <> '')"
_PASSED = """(status = 'scored' AND completed AND critical_failures = 0
    AND (critical_probe IS NULL OR (critical_expected IS NOT NULL AND coalesce(critical_safe, false) AND CASE critical_expected WHEN 'answer' THEN NOT refused WHEN 'refusal' THEN refused AND appropriate_abstention IS TRUE AND fabricated IS FALSE ELSE false END))
    AND CASE WHEN expected = 'answer' THEN NOT refused AND useful IS TRUE AND supported IS TRUE AND traceable IS TRUE ELSE appropriate_abstention IS TRUE AND fabricated IS FALSE END)"""

ORACLES = {
    "pf01_strict_filter": _duck(_COUNTED.format(f"{_SCOPE} AND (len(r.doc_ids) = 0 OR list_contains(r.doc_ids, c.doc_no)) AND " + " AND ".join(f"(NOT {_ASKS[f]} OR {_ANY[f]})" for f in P.CODES))),
    "pf02_scope_filter": _duck(_COUNTED.format(_SCOPE)),
    "pf03_relaxed_filter": _duck(_COUNTED.format(f"{_SCOPE} AND " + " AND ".join(f"(NOT {_ASKS[f]} OR coalesce(len(c.{f}), 0) = 0 OR {_ANY[f]})" for f in ("message_ids", "system_codes")))),
    "pf14_carries_identifier": _duck(_COUNTED.format(" OR ".join(_ANY.values()))),
    "pf15_same_scope": _duck("SELECT a.source, count(*) AS pairs, sum((a.product IS NOT DISTINCT FROM b.product AND a.version IS NOT DISTINCT FROM b.version)::BIGINT) AS same FROM chunks a JOIN chunks b ON a.source = b.source AND b.page_start = a.page_start + 1 GROUP BY ALL"),
    "pf08_leading_title": "SELECT doc_id, doc_id < 20 AND doc_id % 3 = 0 AND source IS NOT NULL AS leading FROM documents",
    "wn06_page_key": _duck("SELECT doc_no, CASE WHEN doc_id % 7 > 0 THEN 'pdf:' || page_start ELSE coalesce(page_label, '') END AS page_key, count(*) AS n FROM chunks GROUP BY ALL"),
    "ag07_edge_pages": _duck("""SELECT source, f.page_start AS page, f.label, l.page_start AS last_page, l.label AS last_label FROM
        (SELECT source, page_start, CASE WHEN count(DISTINCT page_label) = 1 THEN min(page_label) END AS label FROM chunks GROUP BY source, page_start QUALIFY page_start = min(page_start) OVER (PARTITION BY source)) f JOIN
        (SELECT source, page_start, CASE WHEN count(DISTINCT page_label) = 1 THEN min(page_label) END AS label FROM chunks GROUP BY source, page_start QUALIFY page_start = max(page_start) OVER (PARTITION BY source)) l USING (source)"""),
    "fn14_plain_label": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN (doc_id % 90)::VARCHAR WHEN 4 THEN '1-' || doc_id % 90 ELSE '' END AS label FROM documents",
    "fn37_heading_path": """WITH t AS (SELECT doc_id, list_transform(string_split(text, ' ')[1:12], lambda x: repeat(x, 12)) AS ts FROM documents)
        SELECT doc_id, coalesce(list_filter(list_transform(range(1, len(ts) + 1), lambda i: array_to_string(ts[i:], ' > ')), lambda p: length(p) <= 512)[1], ts[-1]) AS path FROM t""",
    "fn41_context": r"SELECT doc_id, rtrim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 120)) AS context FROM documents",
    "fn45_line_kinds": rf"""WITH ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), ts AS (SELECT *, {_TOKENS} AS t FROM ls)
        SELECT doc_id, sum((len(t) >= 3 AND len(regexp_extract_all(line, '\p{{Lu}}')) <= len(regexp_extract_all(line, '\p{{Ll}}'))
            AND len(list_filter(t, lambda x: regexp_full_match(trim(x, '"''’“”()[]{{}}<>.,;:!?'), '\p{{L}}+([''’-]\p{{L}}+)*'))) >= 0.7 * len(t))::BIGINT)::BIGINT AS prose,
        sum((len(t) > 0 AND len(list_filter(t, lambda x: regexp_full_match(x, '[0-9A-Fa-f]{{4,}}'))) >= 0.5 * len(t))::BIGINT)::BIGINT AS hex FROM ts GROUP BY doc_id""",
    "fn64_token_run": """WITH t AS (SELECT doc_id, string_split(text, ' ') AS ts FROM documents), n AS (SELECT *, ts[greatest(len(ts) - 3, 1):greatest(len(ts) - 3, 1) + 2] AS need FROM t)
        SELECT doc_id, true AS own, len(list_filter(range(1, least(len(ts), 40) - len(need) + 2), lambda i: ts[i:i + len(need) - 1] = list_reverse(need))) > 0 AS turned FROM n""",
    "fn49_verification_state": """SELECT CASE WHEN event_id % 29 = 0 THEN 'insufficient_evidence' WHEN event_id % 23 = 0 OR event_id % 9 = 0 THEN 'generation_incomplete' WHEN event_id % 11 = 0 THEN 'insufficient_evidence'
        WHEN event_id % 5 = 0 AND event_id % 2 = 0 THEN 'unverified_draft' WHEN event_id % 5 = 0 THEN 'generation_incomplete' WHEN event_id % 4 = 0 OR event_id % 7 = 0 THEN 'unverified_draft' ELSE 'accepted' END AS state, count(*) AS n FROM events GROUP BY ALL""",
    "fn70_no_hits_message": _duck("""SELECT item_id, CASE WHEN len(t) = 0 THEN 'No supporting manual excerpts were found for this question.' WHEN len(t) > 5 THEN 'No manual excerpts carry ' || array_to_string(t[1:5], ', ') || ', +' || (len(t) - 5) || ' more.'
        ELSE 'No manual excerpts carry ' || array_to_string(t, ', ') || '.' END AS message FROM (SELECT item_id, list_concat(list_concat(list_concat(message_ids, doc_ids), members), string_split(text, ' ')[1:item_id % 5]) AS t FROM requests)"""),
    "pf11_skip_gate": """SELECT doc_id, doc_id % 13 > 0 AND doc_id % 4 > 0 AND doc_id % 10 > 0 AND text IS NOT NULL AND doc_id % 3 > 0 AND (doc_id % 5 IN (2, 3, 4) OR doc_id % 5 = 0 AND doc_id % 2 = 0) AS skip FROM documents""",
    "pf13_case_scope": _duck("""SELECT scope, count(*) FILTER ((scope LIKE 'all%' OR string_split(scope, ':')[1] = expected) AND (NOT contains(scope, ':') OR string_split(scope, ':')[2] = 'c' || case_id % 3)) AS n
        FROM outcomes, (VALUES ('all'), ('answer'), ('abstain:c1'), ('all:c2'), ('answer:c0')) s(scope) GROUP BY scope"""),
    "gt10_case_pass": _duck(f"SELECT event_id, {_PASSED} AS passed FROM outcomes"),
    "jn10_case_means": _duck(f"""SELECT c.case_id, round(coalesce(sum({_PASSED}::INT), 0) / 3, 6) AS mean FROM (SELECT DISTINCT event_id // 2 AS case_id FROM events) c LEFT JOIN (SELECT * EXCLUDE (case_id) FROM outcomes) o ON o.event_id // 3 = c.case_id GROUP BY ALL"""),
    "jn15_tuning_overlap": r"""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q FROM documents) SELECT doc_id FROM t WHERE doc_id % 2 = 0 AND q IN (SELECT q FROM t WHERE doc_id % 2 = 1)""",
    "st12_duplicates": "SELECT lower(line) AS key, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY ALL HAVING n > 1",
    "st05_set_differences": _duck("SELECT doc_no, source, 'left' AS side, count(*) AS n FROM chunks WHERE doc_id % 31 = 0 GROUP BY ALL"),
    "wn16_nearest_first": _duck("""SELECT hit_id, row_number() OVER (PARTITION BY hit_id ORDER BY abs(o), o < 0) AS place, o AS offset, doc_id FROM (SELECT * FROM (
        SELECT h.doc_id AS hit_id, (c.page_start - h.page_start)::INT AS o, min(c.doc_id) AS doc_id FROM chunks h JOIN chunks c ON c.source = h.source AND c.page_start <> h.page_start AND abs(c.page_start - h.page_start) <= 3
        WHERE h.doc_id % 100 = 0 GROUP BY ALL) QUALIFY count(*) OVER (PARTITION BY hit_id, sign(o) ORDER BY abs(o)) = abs(o)) QUALIFY place <= 4"""),
    "tk11_keyset_page": "SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS nth, (SELECT count(*) FROM documents WHERE doc_id > 25) > 40 AS more FROM documents WHERE doc_id > 25 ORDER BY doc_id LIMIT 40",
    "gt23_refused_removals": _duck("SELECT DISTINCT doc_no, source FROM chunks WHERE doc_id % 3 = 0 EXCEPT SELECT doc_no, source FROM chunks WHERE doc_id % 2 = 0"),
    "sc03_vendor": "SELECT CASE WHEN doc_id % 7 IN (0, 1) THEN 'Broadcom' WHEN doc_id % 7 = 2 THEN 'BMC' WHEN doc_id % 7 IN (3, 5) THEN 'Red Hat' ELSE 'unknown' END AS vendor, count(*) AS n FROM documents GROUP BY ALL",
}


def _pins_sql() -> str:
    from .retrieval import _ALL, _PLAIN_CUT, _fuse_sql

    return f"{_ALL}, {_fuse_sql()}, {_PLAIN_CUT} SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY s.rank) AS place FROM sparse s JOIN (SELECT item_id, doc_id FROM cut WHERE rank < 8) USING (item_id, doc_id) QUALIFY place <= 4"


ORACLES["wn10_pinned_hits"] = _pins_sql()
