"""Scalar rules over text, applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .dialect import registered

#: Notes with identifiers, derived from every event.
NOTES = """SELECT event_id, user_id, 'See SA' || lpad(CAST(user_id % 90 + 10 AS STRING), 2, '0') || '-' || lpad(CAST(event_id % 10000 AS STRING), 4, '0')
 || CASE WHEN event_id % 3 = 0 THEN '-' || lpad(CAST(event_id % 100 AS STRING), 2, '0') ELSE '' END || ' for ' || upper(substr(event_type, 1, 3)) || lpad(CAST(event_id % 1000 AS STRING), 3, '0')
 || 'I and PROG' || lpad(CAST(user_id % 100 AS STRING), 2, '0') || ' or ieasysxx, abend S0C' || CAST(event_id % 8 AS STRING) || ' after U' || lpad(CAST(event_id % 9000 AS STRING), 4, '0')
 || ', wait state 06' || CAST(user_id % 10 AS STRING) || ', completion code ' || CAST(200 + event_id % 700 AS STRING) || ', model S390 of ' || event_type AS note FROM events"""


def identifiers(q):
    """Sorted distinct document numbers, message ids and members, and what kind of query that makes."""
    found = {"docnos": T.DOCNO, "messages": T.MESSAGE, "members": T.MEMBER}
    arrays = ", ".join(f"{q.sorted_distinct(q.all('note', p, 1))} AS {k}" for k, p in found.items())
    shown = ", ".join(f"{q.join(k, ',')} AS {k}" for k in found)
    return f"SELECT event_id, {shown}, CASE WHEN {q.size('docnos')} + {q.size('messages')} + {q.size('members')} > 0 THEN 'identifier' ELSE 'nl' END AS kind FROM (SELECT event_id, {arrays} FROM ({NOTES}) n) f"


def system_codes(q):
    """System, user and wait-state codes; bare ones only next to a code phrase. Model numbers are no codes."""
    text = q.replace("note", r"\bS(370|390)\b", " ")
    phrase = r"(?:abend\w*|(?:completion|system)\s+codes?)\s+(?:(?:codes?|error|status|value|hex)\s+)?"
    digit = lambda x: q.filter(q.map(x, "c", "upper(c)"), "c", q.like("c", "[0-9]"))
    s_form, bare = digit(q.all("t", r"(?i)\bS([0-9A-F]{3})\b", 1)), digit(q.all("t", rf"(?i){phrase}([0-9A-F]{{3}})\b", 1))
    user = q.map(q.all("t", r"(?i)\bU(\d{4})\b", 1), "c", "'U' || c")
    wait = q.map(q.all("t", r"(?i)\bwait\s+state\s+([0-9A-F]{3})\b", 1), "c", "'W' || upper(c)")
    joined = f"concat({s_form}, {bare}, {user}, {wait})" if q.name == "spark" else f"list_concat(list_concat({s_form}, {bare}), list_concat({user}, {wait}))"
    return f"SELECT event_id, {q.join(q.sorted_distinct(joined), ',')} AS codes FROM (SELECT event_id, {text} AS t FROM ({NOTES}) n) f"


def members_folded(q):
    """Members as typed in any case, folded to capitals with a small xx at the end, with the exact ones."""
    folded = q.map(q.all("note", T.MEMBER_TYPED, 1), "m", q.replace("upper(m)", "XX$", "xx"))
    union = f"concat({folded}, {q.all('note', T.MEMBER, 1)})" if q.name == "spark" else f"list_concat({folded}, {q.all('note', T.MEMBER, 1)})"
    return f"SELECT event_id, {q.join(q.sorted_distinct(union), ',')} AS members FROM ({NOTES}) n"


def edition_family(q):
    """A form number without its edition stands for all its editions."""
    n = q.range("0", "99")
    every = q.map(n, "n", "stem || '-' || lpad(CAST(n AS STRING), 2, '0')")
    return f"SELECT event_id, stem, {q.size(every)} + 1 AS members, {q.at(every, 1)} AS first_edition, {q.at(every, 100)} AS last_edition FROM (SELECT event_id, {q.extract('note', '([A-Z]{2,4}[0-9]{2}-[0-9]{4})', 1)} AS stem FROM ({NOTES}) n WHERE event_id % 3 <> 0) f"


def form_family(q):
    return f"SELECT event_id, {q.extract('note', '([A-Z]{2,4}[0-9]{2}-[0-9]{4})', 1)} AS family, {q.replace('note', T.DOCNO, '')} AS stripped FROM ({NOTES}) n"


def chunk_types(spark, d):
    """message, syntax, table or narrative for every document."""
    return table(spark, d, "documents").select("doc_id", T.chunk_type(F.col("text")).alias("chunk_type"))


def page_types(spark, d):
    return table(spark, d, "pages").select("page_id", T.chunk_type(F.col("html")).alias("chunk_type"))


def sanitized(q):
    """Pages without terminal escapes, controls, bidi overrides and zero-width characters; ligatures spelled out."""
    t = "html"
    for p in ("\x1b\\[[0-?]*[ -/]*[@-~]", "[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]", "[‪-‮⁦-⁩]", "[​-‍﻿]"):
        t = q.replace(t, p, "")
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"SELECT page_id, {q.sha256(t)} AS clean_sha256, length({t}) AS n FROM pages"


def citations(q):
    """`<id> <title>, <heading>, p. PDF <n>` with fields on one line, bounded by an ellipsis."""

    def field(x: str, limit: int) -> str:
        flat = f"trim({q.replace(x, '[[:space:]]+' if q.name == 'duck' else '[ \\t-\\r]+', ' ')})"
        return f"CASE WHEN length({flat}) > {limit} THEN rtrim(substr({flat}, 1, {limit - 1})) || '…' ELSE {flat} END"

    return f"SELECT doc_id, concat_ws(', ', source || ' ' || {field(q.at(q.split('text', '.'), 1), 200)}, nullif({field('lang', 400)}, ''), 'p. PDF ' || CAST({q.idiv('doc_id', '20')} + 1 AS STRING)) AS cite FROM documents"


def source_revisions(q):
    """Normalised, escaped labels and a content digest joined by bars, for every part."""
    norm = lambda x: f"replace(replace(lower(trim({q.replace(f'coalesce({x}, chr(32))', ' +', ' ')})), chr(92), chr(92) || chr(92)), '|', chr(92) || '|')"
    return f"SELECT p_partkey, {norm('p_brand')} || '|' || {norm('p_type')} || '|' || {norm('p_name')} || '|' || {q.sha256('p_name')} AS source_rev FROM part"


def chunk_ids(q):
    """Name-based UUIDs (version 5, URL namespace) of source, language, page and ordinal."""
    key = f"source || '|' || lang || '|' || CAST({q.idiv('doc_id', '20')} AS STRING) || '|0'"
    ns = "unhex('6ba7b8119dad11d180b400c04fd430c8')"
    h = f"sha1(concat({ns}, encode({key}, 'UTF-8')))" if q.name == "spark" else f"sha1({ns} || encode({key}))"
    variant = "substr('89ab', CAST(instr('0123456789abcdef', substr(h, 17, 1)) - 1 AS INT) % 4 + 1, 1)"
    return f"SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || {variant} || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM (SELECT doc_id, {h} AS h FROM documents) d"


def embed_texts(q):
    """Header, title, heading and body on lines of their own, empty ones left out."""
    head = "concat_ws(' ', nullif(source, ''), nullif(lang, ''), CAST(doc_id AS STRING))"
    return f"SELECT doc_id, {q.sha256(f'concat_ws(chr(10), {head}, nullif(source, chr(32)), text)')} AS embed_sha256 FROM documents"


def rerank_texts(q):
    """Passages of at most 3000 characters; the header stays whole and the body's end goes."""
    head = "source || ' ' || CAST(doc_id AS STRING) || ' [narrative]' || chr(10) || lang"
    passage = f"{head} || chr(10) || substr(text, 1, 3000 - length({head}) - 1)"
    return f"SELECT doc_id, length({passage}) AS n, {q.sha256(passage)} AS passage_sha256 FROM documents"


def token_estimates(q):
    """Words and marks, at least one for a text that isn't empty; and the upper bound by runs."""
    tokens = q.size(q.all("text", r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))
    natural = f"(length(r) <= 15 AND {q.like('r', '^[A-Za-z][a-z]*$')})"
    run = f"CASE WHEN {q.like('r', '^[A-Za-z0-9]')} THEN CASE WHEN {natural} THEN {q.idiv('(length(r) + 1)', '2')} ELSE length(r) END WHEN ascii(r) < 128 THEN 1 ELSE {q.bytes('r')} END"
    runs = q.map(q.all("text", r"[A-Za-z0-9]+|\n|[ \t]{2,}|[^\sA-Za-z0-9]"), "r", f"CAST({run} AS BIGINT)")
    total = f"aggregate({runs}, 0L, (a, x) -> a + x)" if q.name == "spark" else f"coalesce(list_sum({runs}), 0)"
    return f"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, {tokens}) END AS estimate, CAST({total} AS BIGINT) AS upper_bound FROM documents"


def lexical_overlap(q):
    """Share of a conversation text's distinct terms that the turn before it holds, and whether it copies its first words."""
    terms = lambda x: f"{q.sorted_distinct(q.all(f'lower({x})', '[a-z0-9]{2,}'))}"
    lead = f"slice({q.split('lower(text)', ' ')}, 1, 2)" if q.name == "spark" else f"({q.split('lower(text)', ' ')})[1:2]"
    return f"""SELECT conv_id, turn, round(CASE WHEN {q.size('a')} = 0 THEN 0 ELSE CAST({q.size(q.both('a', 'b'))} AS DOUBLE) / {q.size('a')} END, 6) AS overlap, contains(' ' || lower(before) || ' ', ' ' || {q.join(lead, ' ')} || ' ') AS copies
     FROM (SELECT *, {terms('text')} AS a, {terms('before')} AS b FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations) w) t"""


def edit_distance(q):
    """Character error rate of each turn against the turn before it, in fixed classes. DuckDB counts bytes, so this is held against brute force."""
    rate = "CAST(levenshtein(a, b) AS DOUBLE) / length(a)"
    return f"""SELECT conv_id, turn, round({rate}, 6) AS cer, CASE WHEN {rate} = 0 THEN '0' WHEN {rate} < 0.05 THEN '<0.05' WHEN {rate} < 0.2 THEN '<0.2' WHEN {rate} < 0.5 THEN '<0.5' ELSE '>=0.5' END AS bucket
     FROM (SELECT conv_id, turn, t AS b, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM (SELECT conv_id, turn, text AS t FROM conversations) c) w WHERE a IS NOT NULL AND a <> ''"""


def failure_buckets(q):
    """Failure texts without details, quotes and leading counts."""
    text = "CAST(event_id % 7 AS STRING) || ' ' || event_type || ' failed (id: ' || CAST(event_id AS STRING) || ') at [' || props || '] by ''u' || CAST(user_id AS STRING) || ''': detail ' || CAST(value AS STRING)"
    if q.name == "spark":
        text = text.replace("''u'", "\\'u'").replace("|| ''':", "|| '\\':")
    red = q.replace(text, r"\([^()]*:[^()]*\)|\[[^\[\]]*\]|'[^']*'", "…")
    return f"SELECT event_id, trim({q.at(q.split(q.replace(red, '^[0-9]+ ', 'N '), ':'), 1)}) AS bucket FROM events"


def complexity(q):
    """simple or complex, by roots and phrases; an identifier makes it simple."""
    low = "lower(trim(text))"
    roots = " OR ".join(f"contains({low}, '{r}')" for r in ("diagnos", "recover", "abend", "compar", "tuning", "optimi", "tradeoff"))
    more = " OR ".join(f"contains({low}, '{r}')" for r in ("how to configure", "how do i configure", "how to setup", "how do i create", "step by step", "steps to", "configuration procedure", "versus", " vs ", "difference between"))
    ask, topic = (" OR ".join(f"contains({low}, '{r}')" for r in words) for words in (("how to", "how do", "how can", "explain how", "procedure"), ("rule", "interval", "parameter", "parmlib", "jcl", "policy", "threshold", "journal")))
    rule = f"WHEN ({ask}) AND ({topic}) THEN 'complex' "
    return f"SELECT conv_id, turn, CASE WHEN {q.like('text', T.MESSAGE)} AND NOT ({roots}) THEN 'simple' WHEN {roots} OR {more} THEN 'complex' {rule}ELSE 'simple' END AS complexity FROM conversations"


def queries_normalised(q):
    """Lower-cased turns with blanks collapsed, and which of them repeat an earlier query."""
    norm = f"trim({q.replace('lower(text)', '[ ]+', ' ')})"
    return f"SELECT conv_id, turn, {q.sha256('n')} AS query_sha256, row_number() OVER (PARTITION BY n ORDER BY conv_id, turn) > 1 AS repeated FROM (SELECT conv_id, turn, {norm} AS n FROM conversations WHERE role = 'user') u"


def selections(q):
    """Numbers parsed from a reply like [3, 1, 3], in order, each once and within the count."""
    reply = "'pick [' || CAST(event_id % 9 AS STRING) || ', ' || CAST(user_id % 12 AS STRING) || ', ' || CAST(event_id % 9 AS STRING) || ']'"
    numbers = q.map(q.all(reply, "[0-9]+"), "x", "CAST(x AS INT)")
    kept = q.filter(numbers, "x", "x BETWEEN 1 AND 8")
    once = f"array_distinct({kept})" if q.name == "spark" else f"list_filter({kept}, lambda x, i: list_position({kept}, x) = i)"
    return f"SELECT event_id, {q.join(q.map(once, 'x', 'CAST(x AS STRING)'), ',')} AS picked FROM events"


def timings(q):
    """Stage times parsed from a header like embed;dur=1.5, store;dur=2."""
    header = "'embed;dur=' || CAST(event_id % 50 AS STRING) || '.5, store;dur=' || CAST(user_id AS STRING)"
    get = lambda s: f"CAST({q.extract('h', s + ';dur=([0-9.]+)', 1)} AS DOUBLE)"
    return f"SELECT event_id, {get('embed')} AS embed_ms, {get('store')} AS store_ms FROM (SELECT event_id, {header} AS h FROM events) t"


def judge_labels(q):
    """A label from the JSON in a reply."""
    return f"SELECT event_id, {q.json('props', 'k')} AS k, coalesce({q.json('props', 'missing')}, 'unknown') AS label FROM events"


QUERIES, ORACLES = registered(
    {
        "fn01_identifiers": identifiers,
        "fn04_system_codes": system_codes,
        "fn05_members_folded": members_folded,
        "st03_edition_family": edition_family,
        "fn66_form_family": form_family,
        "fn18_sanitize": sanitized,
        "fn16_citation": citations,
        "fn39_source_rev": source_revisions,
        "fn00_uuid5_chunk_id": chunk_ids,
        "fn40_embed_text": embed_texts,
        "fn42_rerank_text": rerank_texts,
        "fn55_token_estimate": token_estimates,
        "fn63_lexical_overlap": lexical_overlap,
        "fn65_edit_distance_cer": edit_distance,
        "fn59_failure_bucket": failure_buckets,
        "fn46_complexity": complexity,
        "fn67_query_normalised": queries_normalised,
        "fn69_selection": selections,
        "fn58_server_timing": timings,
        "fn68_judge_label": judge_labels,
    }
)
QUERIES |= {"fn24_chunk_type": chunk_types, "fn25_page_types": page_types}
ORACLES |= {"fn24_chunk_type": T.CHUNK_TYPE_SQL, "fn25_page_types": f"SELECT doc_id AS page_id, chunk_type FROM ({T.CHUNK_TYPE_SQL.replace('FROM documents', 'FROM (SELECT page_id AS doc_id, html AS text FROM pages)')})"}
# DuckDB's levenshtein counts bytes, so no SQL is given; tests hold the query against brute force.
ORACLES.pop("fn65_edit_distance_cer")
