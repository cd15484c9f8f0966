"""Answer assembly and feedback. Events are answers, labels their ratings, documents the evidence."""

from __future__ import annotations

from .dialect import registered


def rated(q):
    """Ratings with their answers; ratings of unknown answers are left out."""
    return "SELECT e.event_id, event_type, user_id, value, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS rating, ts FROM labels l JOIN events e ON e.event_id = l.doc_id"


def refused_ratings(q):
    anti = "LEFT ANTI JOIN" if q.name == "spark" else "ANTI JOIN"
    return f"SELECT l.doc_id FROM labels l {anti} events e ON e.event_id = l.doc_id * 40"


def import_plan(q):
    """Incoming records against those held: insert, duplicate or conflict."""
    return "SELECT state, count(*) AS n FROM (SELECT CASE WHEN b.event_id IS NULL THEN 'insert' WHEN a.event_type = b.event_type AND a.value = b.value THEN 'duplicate' ELSE 'conflict' END AS state FROM events a LEFT JOIN (SELECT event_id * 2 AS event_id, event_type, CASE WHEN event_id % 3 = 0 THEN value ELSE value + 1 END AS value FROM events) b ON a.event_id = b.event_id) s GROUP BY state"


def retention(q):
    """What a purge keeps: answers of the last ten days, and how many ratings stay with them."""
    cut = "(SELECT max(ts) FROM events) - INTERVAL 10 DAYS"
    return f"SELECT event_type, count(*) AS kept, count(l.doc_id) AS ratings FROM events e LEFT JOIN labels l ON l.doc_id = e.event_id WHERE ts >= {cut} GROUP BY event_type"


def insert_once(q):
    """The first record of a request stays."""
    return "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) e WHERE r = 1"


def report_cells(q):
    """Bad shares by endpoint, with a flag for few ratings."""
    return f"SELECT event_type, count(*) AS n, sum(CASE WHEN rating = 'bad' THEN 1 ELSE 0 END) AS bad, round(CAST(sum(CASE WHEN rating = 'bad' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 4) AS bad_share, count(*) < 5 AS low_n FROM ({rated(q)}) r GROUP BY event_type"


def report_dimensions(q):
    """Counts along several dimensions in one pass."""
    return f"SELECT coalesce(event_type, '-') AS endpoint, coalesce(rating, '-') AS rating, coalesce(day, '-') AS day, count(*) AS n FROM (SELECT event_type, rating, {q.day('ts')} AS day FROM ({rated(q)}) r) d GROUP BY GROUPING SETS ((event_type), (rating), (day), (event_type, rating))"


def identity_buckets(q):
    """The eight most frequent users by count and name; the rest is other. Eight rows are cut and joined back, so no task numbers all users."""
    counted = "SELECT user_id, count(*) AS n FROM events GROUP BY user_id"
    label = "CASE WHEN t.n IS NOT NULL THEN 'u' || CAST(c.user_id AS STRING) ELSE 'other' END"
    same = "c.user_id <=> t.user_id" if q.name == "spark" else "c.user_id IS NOT DISTINCT FROM t.user_id"
    return f"SELECT {label} AS label, sum(c.n) AS n FROM ({counted}) c LEFT JOIN (SELECT user_id, n FROM ({counted}) d ORDER BY n DESC, user_id LIMIT 8) t ON {same} GROUP BY {label}"


def top_codes(q):
    """The five most frequent codes of each type."""
    return f"SELECT event_type, code, n FROM (SELECT event_type, code, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, code) AS r FROM (SELECT event_type, CAST({q.json('props', 'k')} AS INT) AS code, count(*) AS n FROM events GROUP BY event_type, CAST({q.json('props', 'k')} AS INT)) c) d WHERE r <= 5"


def report_quantiles(q):
    """Midpoint median and nearest-rank 95th percentile, by endpoint."""
    return f"SELECT event_type, round({q.cont('value', 0.5)}, 1) AS median, round({q.disc('value', 0.95)}, 1) AS p95, count(*) < 5 AS low_n FROM events GROUP BY event_type"


def review_queue(q):
    """Bad ratings, the newest first, two hundred at most."""
    return f"SELECT event_id, event_type, r AS place FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY ts DESC, event_id) AS r FROM ({rated(q)}) x WHERE rating = 'bad') y WHERE r <= 200"


def report_coverage(q):
    """How many answers are rated, and how old the last rating is."""
    return f"SELECT count(*) AS answers, count(l.doc_id) AS rated, round(CAST(count(l.doc_id) AS DOUBLE) / count(*), 4) AS share, {q.epoch('max(ts)')} - {q.epoch('max(CASE WHEN l.doc_id IS NOT NULL THEN ts END)')} AS stale_seconds FROM events e LEFT JOIN labels l ON l.doc_id = e.event_id"


def turns(q):
    """Turn groups of a conversation: each starts at a user's message."""
    return "SELECT conv_id, grp, min(turn) AS first_turn, count(*) AS messages, sum(length(text)) AS chars FROM (SELECT conv_id, turn, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS grp FROM conversations) t GROUP BY conv_id, grp"


def drop_oldest(q):
    """The newest messages of a conversation that fit a budget of characters."""
    return "SELECT conv_id, turn, chars FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS chars FROM conversations) t WHERE chars <= 3000"


def anchors(q):
    """Each user message with the user message before it, and whether it may lean on that."""
    return "SELECT conv_id, turn, prev_turn, prev_turn IS NOT NULL AND length(text) < 400 AS follow_up FROM (SELECT conv_id, turn, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_turn FROM conversations WHERE role = 'user') t"


def _hits(q) -> str:
    """The three longest documents of each source as its hits."""
    return f"SELECT source, doc_id, {q.idiv('doc_id', '20')} AS page, n_chars, r FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) d WHERE r <= 3"


def neighbours(q):
    """Pages within two of a hit in the same source, nearest first, each page once and no hit itself."""
    page = q.idiv("d.doc_id", "20")
    anti = "LEFT ANTI JOIN" if q.name == "spark" else "ANTI JOIN"
    return f"""WITH hits AS ({_hits(q)}), near AS (SELECT h.source, d.doc_id, abs({page} - h.page) AS distance, {page} < h.page AS backward, h.r FROM hits h JOIN documents d ON d.source = h.source AND {page} BETWEEN h.page - 2 AND h.page + 2),
     once AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY distance, r, backward) AS nth FROM near),
     free AS (SELECT o.* FROM once o {anti} hits h ON o.doc_id = h.doc_id WHERE nth = 1)
     SELECT source, doc_id, distance, slot FROM (SELECT source, doc_id, distance, row_number() OVER (PARTITION BY source ORDER BY distance, r, backward, doc_id) AS slot FROM free) s WHERE slot <= 4"""


def pack_budget(q):
    """Documents of a source by rank until the budget of tokens is used; the one that doesn't fit ends the list."""
    tokens = f"greatest(1, {q.size(q.all('text', r'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))})"
    return f"SELECT source, doc_id, r, used FROM (SELECT source, doc_id, r, sum(tokens) OVER (PARTITION BY source ORDER BY r ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS r, {tokens} AS tokens FROM documents) d) e WHERE used <= 2000"


def supplied_bound(q):
    """Evidence in order up to a total of characters, with what of each row fits."""
    return "SELECT source, doc_id, CASE WHEN upto <= 20000 THEN n_chars ELSE 20000 - (upto - n_chars) END AS kept FROM (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents) d WHERE upto - n_chars < 20000"


def trim_tail(q):
    """What stays when a weight is trimmed from the end of each source's rows."""
    return "SELECT source, doc_id, greatest(0, least(n_chars, n_chars - (5000 - (after - n_chars)))) AS kept FROM (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS after FROM documents) d WHERE after - n_chars < 5000"


def selection_order(q):
    """Pinned rows first, then chosen ones in the chooser's order, then the rest by rank."""
    return "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY grp, pos, doc_id) AS place FROM (SELECT d.source, d.doc_id, CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 1 ELSE 2 END AS grp, CASE WHEN l.quality = 1 THEN -d.n_chars ELSE d.n_chars END AS pos FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) s"


def evidence(q):
    """Bytes and digest of each document's first line as a piece of evidence."""
    unit = q.at(q.split("text", "\n"), 1)
    return f"SELECT doc_id, {q.idiv('doc_id', '20')} + 1 AS page, {q.bytes(unit)} AS byte_end, {q.sha256(unit)} AS digest FROM documents"


def citation_match(q):
    """Citations matched to hits by their text; the first of equal ones wins."""
    return f"WITH cites AS (SELECT conv_id, turn, 'src' || CAST(conv_id % 20 AS STRING) || ' p. ' || CAST(turn AS STRING) AS cite FROM conversations WHERE role = 'assistant'), hits AS (SELECT source || ' p. ' || CAST({q.idiv('doc_id', '20')} AS STRING) AS cite, min(doc_id) AS doc_id FROM documents GROUP BY source || ' p. ' || CAST({q.idiv('doc_id', '20')} AS STRING)) SELECT conv_id, turn, c.cite, h.doc_id FROM cites c LEFT JOIN hits h ON c.cite = h.cite"


def red_metrics(q):
    """Requests, errors and duration by endpoint and day."""
    return f"SELECT {q.day('ts')} AS day, event_type, count(*) AS requests, sum(CASE WHEN value > 90 THEN 1 ELSE 0 END) AS errors, {q.disc('value', 0.95)} AS p95 FROM events GROUP BY {q.day('ts')}, event_type"


def tumbling(q):
    """Events and values by six-hour window. An extension: the reference has no windows."""
    start = f"{q.idiv(q.epoch('ts'), '21600')} * 21600"
    return f"SELECT {start} AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY {start}, event_type"


def sessions(q):
    """Sessions of a user, split where an hour passes without an event. An extension."""
    gap = f"CASE WHEN {q.epoch('ts')} - lag({q.epoch('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600 THEN 0 ELSE 1 END"
    return f"SELECT user_id, s AS session, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM (SELECT user_id, event_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, event_id, ts, {gap} AS fresh FROM events) g) t GROUP BY user_id, s"


QUERIES, ORACLES = registered(
    {
        "jn02_rated": rated,
        "jn04_refused_ratings": refused_ratings,
        "jn03_import_plan": import_plan,
        "sk18_retention": retention,
        "sk15_insert_once": insert_once,
        "ag33_report_cells": report_cells,
        "ag32_report_dimensions": report_dimensions,
        "ag34_identity_buckets": identity_buckets,
        "ag35_top_codes": top_codes,
        "ag25_report_quantiles": report_quantiles,
        "wn27_review_queue": review_queue,
        "gt48_report_coverage": report_coverage,
        "wn28_turns": turns,
        "tk09_drop_oldest": drop_oldest,
        "gt43_anchors": anchors,
        "jn08_neighbours": neighbours,
        "tk07_pack_budget": pack_budget,
        "tk10_supplied_bound": supplied_bound,
        "tk08_trim_tail": trim_tail,
        "wn11_selection_order": selection_order,
        "mx02_evidence": evidence,
        "jn09_citation_match": citation_match,
        "mx03_red_metrics": red_metrics,
        "ext_tumbling": tumbling,
        "ext_sessions": sessions,
    }
)
