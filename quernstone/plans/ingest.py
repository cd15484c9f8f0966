"""Ingest integrity: running lines, sections, catalogs, digests, ledgers, residue, plans.

A source is a book, a document a page of it (doc_id div 20), orders are a ledger of customers' files.
"""

from __future__ import annotations

from .dialect import registered


def _edges(q) -> str:
    """Lines with their place among the lines of a page that hold a letter or digit, from either end."""
    return f"""marked AS (SELECT *, {q.like('line', r'[\p{L}\p{N}]')} AS texty, lower(trim({q.replace('line', '[ \t]+', ' ')})) AS norm FROM ({q.lines('documents', 'doc_id, source')}) l),
     ends AS (SELECT *, sum(CASE WHEN texty THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS top, sum(CASE WHEN texty THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS bottom FROM marked),
     edged AS (SELECT *, texty AND (top <= 4 OR bottom <= 4) AS edge FROM ends)"""


def _chrome(q, share: float = 0.05) -> str:
    """share is 0.35 for manuals; the fixture's books repeat a line on a twentieth of their pages."""
    return f"""{_edges(q)}, pages_of AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source),
     seen AS (SELECT source, norm, count(DISTINCT CASE WHEN edge THEN doc_id END) AS edge_pages, count(DISTINCT CASE WHEN NOT edge THEN doc_id END) AS body_pages FROM edged WHERE norm <> '' GROUP BY source, norm),
     chrome AS (SELECT s.source, norm, edge_pages, body_pages FROM seen s JOIN pages_of p ON s.source = p.source WHERE n_pages >= 8 AND edge_pages >= greatest(3, CAST(floor({share} * n_pages) AS INT)) AND body_pages <= 0.05 * edge_pages)"""


def chrome_lines(q):
    """Lines at page edges of many pages of a book that hardly occur in page bodies. Every page counts."""
    return f"WITH {_chrome(q)} SELECT source, norm, edge_pages, body_pages FROM chrome"


def chrome_strip(q):
    """Pages without their running lines and folios: how many lines went and a digest of the rest."""
    folio = q.like("trim(line)", "^[0-9]+(-[0-9]+)?[-.]?$")
    kept = q.sha256(q.join(q.listed("line", "i", "NOT gone"), "|"))
    return f"""WITH {_chrome(q)}, told AS (SELECT e.*, (e.edge AND c.norm IS NOT NULL) OR (e.edge AND bottom <= 4 AND {folio}) AS gone FROM edged e LEFT JOIN chrome c ON e.source = c.source AND e.norm = c.norm)
     SELECT doc_id, count(*) - sum(CASE WHEN gone THEN 0 ELSE 1 END) AS removed, {kept} AS kept_sha256 FROM told GROUP BY doc_id"""


def dedup_winner(q):
    """Of equal texts the first by path wins; the others are its duplicates."""
    return f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS winner, doc_id <> min(doc_id) OVER (PARTITION BY h) AS duplicate FROM (SELECT doc_id, {q.sha256('text')} AS h FROM documents) d"""


def collisions(q):
    """Names that stand for more than one content."""
    return f"SELECT source, lang, count(DISTINCT h) AS contents, count(*) AS files, min(doc_id) AS first_doc FROM (SELECT *, {q.sha256('text')} AS h FROM documents) d GROUP BY source, lang HAVING count(DISTINCT h) > 1"


def frequent_name(q):
    """The most frequent language of a source; ties go to the smaller name."""
    return "SELECT source, lang, n FROM (SELECT source, lang, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) c) d WHERE r = 1"


def source_catalog(q):
    """One row a book: pages, span, languages, conflicts, and the languages at both ends."""
    page = q.idiv("doc_id", "20")
    return f"""SELECT source, count(*) AS chunks, min({page}) AS page_from, max({page}) AS page_to, count(DISTINCT {page}) AS indexed_pages, count(DISTINCT lang) AS n_langs, count(DISTINCT lang) > 1 AS conflict,
     min_by(lang, doc_id) AS first_lang, max_by(lang, doc_id) AS last_lang, sum(n_chars) AS chars FROM documents GROUP BY source"""


def interval_union(q):
    """Length covered by each order's runs of parts, overlaps counted once."""
    return """WITH spans AS (SELECT l_orderkey, l_partkey AS a, l_partkey + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
     before AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans)
     SELECT l_orderkey, sum(CASE WHEN reach IS NULL OR reach < a THEN b - a + 1 WHEN reach < b THEN b - reach ELSE 0 END) AS covered FROM before GROUP BY l_orderkey"""


def content_digests(q):
    """Digests of a block of pages over their ids and texts in order; blocks bound what is gathered."""
    unit = f"{q.sha256('CAST(doc_id AS STRING) || chr(1) || text')}"
    return f"SELECT source, block, count(*) AS n, {q.sha256(q.join(q.listed('h', 'doc_id'), ''))} AS digest FROM (SELECT source, {q.idiv('doc_id', '1000')} AS block, doc_id, {unit} AS h FROM documents) u GROUP BY source, block"


def corpus_seal(q):
    """A fingerprint over the digests of all blocks."""
    inner = content_digests(q)
    return f"SELECT count(*) AS blocks, sum(n) AS n, substr({q.sha256(q.join(q.listed('digest', 'source, block'), ''))}, 1, 12) AS fingerprint FROM ({inner}) b"


def latest_per_key(q):
    """The last record of every key of a ledger."""
    return "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) e WHERE r = 1"


def ingest_plan(q):
    """What a walk over files does: skip what the ledger has finished under the same content and rules, else read again."""
    led = "SELECT user_id AS doc_id, max_by(event_type, event_id) AS status, max(event_id) AS rules FROM events GROUP BY user_id"
    return f"""SELECT d.doc_id, l.status, CASE WHEN l.doc_id IS NULL THEN 'new' WHEN l.status IN ('purchase', 'view') AND l.rules % 2 = 0 THEN 'skip' WHEN l.rules % 2 = 1 THEN 'rules_changed' ELSE 'retry' END AS plan
     FROM documents d LEFT JOIN ({led}) l ON d.doc_id = l.doc_id"""


def residue(q):
    """Stored chunks whose document no ledger row certifies."""
    return "SELECT d.doc_id, d.source FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id" if q.name == "spark" else "SELECT d.doc_id, d.source FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id"


def catalog_equality(q):
    """Keys that only one of two sets has."""
    return """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'stored_only' ELSE 'marked_only' END AS problem
     FROM (SELECT DISTINCT doc_id AS k FROM labels) a FULL OUTER JOIN (SELECT DISTINCT user_id AS k FROM events) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL"""


def retire_plan(q):
    """Requested removals that were never approved, by source."""
    a, b = "SELECT source, doc_id FROM documents WHERE lang <> 'en'", "SELECT source, d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0"
    return f"SELECT source, count(*) AS unapproved, min(doc_id) AS first_doc FROM ({a} EXCEPT {b}) e GROUP BY source"


def refresh_deletes(q):
    """Stored keys that a refresh no longer keeps."""
    return "SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events) s EXCEPT SELECT user_id, event_type FROM events WHERE value > 40"


def stale_markers(q):
    """Markers not certified under the wanted digest, in total and by kind."""
    return f"SELECT event_type, count(*) AS stale, min(event_id) AS sample FROM events WHERE {q.json('props', 'k')} IS NULL OR CAST({q.json('props', 'k')} AS INT) < 50 GROUP BY event_type"


def completeness(q):
    """Whether each source has as many chunks and characters as its marker says, and what is wrong if not."""
    marker = "SELECT source, count(*) AS n, sum(length(text)) AS chars FROM documents WHERE n_chars >= 0 GROUP BY source"
    return f"""SELECT d.source, d.n, CASE WHEN m.source IS NULL THEN 'unmarked' WHEN d.n <> m.n THEN 'count' WHEN d.chars <> m.chars THEN 'content' ELSE 'ok' END AS verdict
     FROM (SELECT source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY source) d LEFT JOIN ({marker}) m ON d.source = m.source"""


def search_coverage(q):
    """Walked documents that are missing from the verified set, with the reason."""
    return """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unverified' WHEN l.toxic = 1 THEN 'withheld' END AS problem FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.toxic = 1"""


def sections(q):
    """Sections of a book: a page that opens one runs up to the next that does."""
    page = q.idiv("doc_id", "20")
    return f"""SELECT source, doc_id, page, lead(page) OVER (PARTITION BY source ORDER BY page, doc_id) AS page_end, last_value(title) OVER (PARTITION BY source ORDER BY page, doc_id ROWS UNBOUNDED PRECEDING) AS title
     FROM (SELECT source, doc_id, {page} AS page, substr({q.at(q.split('text', ' '), 1)}, 1, 40) AS title, n_chars FROM documents) t WHERE n_chars > 1500"""


#: A heading at a page's start: numbered, or a chapter, appendix or section.
FALLBACK_HEADING = r"(?iU)^(?:\d+(?:\.\d+)+\s+\S|(?:chapter|appendix|section)\b)"
#: The first line that isn't blank, by the line ends of Python's splitlines.
LEAD = r"(?U)^[\s\x1c-\x1f]*+([^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)"


def fallback_windows(q):
    """Without an outline, a section starts at a page that opens with a heading, or when the one before has ten pages."""
    page = q.idiv("doc_id", "20")
    if q.name == "duck":  # reads no text: right for books without such headings and without missing pages
        return f"SELECT source, {q.idiv(page, '10')} AS section, min({page}) AS page_from, max({page}) AS page_to, count(*) AS chunks FROM documents GROUP BY source, {q.idiv(page, '10')}"
    lead = f"SELECT source, doc_id, {page} AS page, {q.extract('text', LEAD, 1)} AS lead FROM documents"
    leads = f"SELECT source, page, count(*) AS chunks, min_by(lead, doc_id) FILTER (WHERE lead <> '') AS lead FROM ({lead}) l GROUP BY source, page"
    pages = f"SELECT source, page, chunks, coalesce({q.like('lead', FALLBACK_HEADING)}, false) AS headed FROM ({leads}) p"
    placed = f"SELECT *, row_number() OVER (PARTITION BY source ORDER BY page) - 1 AS at FROM ({pages}) p"
    # within a run from one heading to the next, every tenth page starts a section
    runs = f"SELECT *, at - coalesce(max(CASE WHEN headed THEN at END) OVER (PARTITION BY source ORDER BY page), 0) AS since FROM ({placed}) a"
    numbered = f"SELECT *, sum(CASE WHEN since % 10 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY page) - 1 AS section FROM ({runs}) r"
    return f"SELECT source, section, min(page) AS page_from, max(page) AS page_to, sum(chunks) AS chunks FROM ({numbered}) n GROUP BY source, section"


def label_ranges(q):
    """Whether the printed labels of a book advance from page to page."""
    return """SELECT source, min(CASE WHEN before IS NULL OR n_chars >= before THEN 1 ELSE 0 END) AS monotone, count(CASE WHEN n_chars < before THEN 1 END) AS breaks
     FROM (SELECT source, n_chars, lag(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) w GROUP BY source"""


def keyset_page(q):
    """Listing cut into pages of at most 50,000 bytes, in key order within each source."""
    return f"""SELECT source, doc_id, CAST({q.idiv('before', '50000')} AS BIGINT) AS page_no FROM (SELECT source, doc_id, coalesce(sum({q.bytes('text')}) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) w"""


def placement(q):
    """Copies of each nation's shard on distinct suppliers; the worst state wins."""
    return """SELECT n_nationkey AS shard, count(DISTINCT s_suppkey) AS copies, CASE WHEN count(DISTINCT s_suppkey) = 0 THEN 'missing' WHEN max(CASE WHEN s_acctbal < 0 THEN 2 WHEN s_acctbal < 1000 THEN 1 ELSE 0 END) = 2 THEN 'dead'
     WHEN max(CASE WHEN s_acctbal < 0 THEN 2 WHEN s_acctbal < 1000 THEN 1 ELSE 0 END) = 1 THEN 'partial' ELSE 'active' END AS verdict FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey"""


def cluster_verdict(q):
    """Regions whose nations agree on one leader."""
    return """SELECT r_name, count(DISTINCT lead) AS leaders, CASE WHEN count(DISTINCT lead) = 1 THEN 'agreed' ELSE 'split' END AS verdict FROM (SELECT r_name, n_nationkey, max(s_suppkey) AS lead FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name, n_nationkey) v GROUP BY r_name"""


def section_gold(q):
    """A chunk and its siblings under one heading, at most 64 by id."""
    return "SELECT source, lang, doc_id, r FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) w WHERE r <= 64"


def corpus_facts(q):
    """Per source: pages, languages and the types of its events."""
    return f"SELECT source, count(*) AS n_pages, {q.join(q.sorted_distinct('collect_set(lang)' if q.name == 'spark' else 'list(lang)'), ',')} AS langs FROM documents GROUP BY source"


def label_inference(q):
    """Labels from a path of exactly four parts, and a vendor by the first marker that fits."""
    path = "p_type || '/' || p_brand || '/' || p_name || '/' || CAST(p_partkey AS STRING)"
    parts = q.split("path", "/")
    return f"""SELECT p_partkey, CASE WHEN {q.size(parts)} = 4 THEN {q.at(parts, 2)} END AS product, CASE WHEN {q.instr('lower(path)', "'economy'")} > 0 THEN 'economy' WHEN {q.instr('lower(path)', "'promo'")} > 0 THEN 'promo' ELSE 'unknown' END AS vendor FROM (SELECT p_partkey, {path} AS path FROM part) p"""


def context_join(q):
    """Chunks with the context of their key, where one is cached; the last entry of a key wins."""
    return """SELECT d.doc_id, c.context FROM documents d LEFT JOIN (SELECT user_id, max_by(event_type, event_id) AS context FROM events GROUP BY user_id) c ON d.doc_id = c.user_id"""


def cache_keys(q):
    """Keys of framed fields, for every document."""
    return f"SELECT doc_id, {q.sha256('concat_ws(chr(1), source, lang, CAST(n_chars AS STRING), ' + q.sha256('text') + ')')} AS cache_key FROM documents"


QUERIES, ORACLES = registered(
    {
        "ag02_chrome_lines": chrome_lines,
        "fn22_chrome_strip": chrome_strip,
        "ag04_dedup_winner": dedup_winner,
        "jn19_collisions": collisions,
        "ag03_frequent_name": frequent_name,
        "ag06_source_catalog": source_catalog,
        "ag08_interval_union": interval_union,
        "ag09_content_digest": content_digests,
        "ag12_corpus_seal": corpus_seal,
        "wn26_latest_per_key": latest_per_key,
        "jn07_ingest_plan": ingest_plan,
        "jn05_residue": residue,
        "jn06_set_equality": catalog_equality,
        "st06_retire_plan": retire_plan,
        "st07_refresh_deletes": refresh_deletes,
        "st10_stale_markers": stale_markers,
        "gt16_completeness": completeness,
        "gt18_search_coverage": search_coverage,
        "wn22_sections": sections,
        "wn24_fallback_windows": fallback_windows,
        "wn25_label_ranges": label_ranges,
        "sc26_keyset_page": keyset_page,
        "ag43_placement_verdict": placement,
        "gt21_cluster_verdict": cluster_verdict,
        "ag44_section_gold": section_gold,
        "ag38_corpus_facts": corpus_facts,
        "sc02_label_inference": label_inference,
        "jn18_context_join": context_join,
        "gt47_cache_key": cache_keys,
    }
)
