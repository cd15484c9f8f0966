"""Rules over a chunk's stored fields: filters, gates, labels and lines, as column expressions.

Field names are those of the stored records. Arguments are SQL expressions or columns, so the rules fit any table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of vendors in their order, bounds of stored fields, marks of pages and document numbers in a
# citation, shapes of words and hex words, and the shares of a line that they must reach.
VENDOR_MARKERS = {
    "broadcom": "Broadcom",
    "ca-": "Broadcom",
    "/ca/": "Broadcom",
    "bmc": "BMC",
    "precisely": "Precisely",
    "ibm": "IBM",
    "red-hat": "Red Hat",
    "redhat": "Red Hat",
}
CITE_LABEL_MAX_CHARS, HEADING_PATH_MAX_CHARS = 32, 512
CITE_DOCNO = r"(?<![A-Za-z0-9])[A-Z]{2,4}\d{2}-\d{4}(?:-\d{2})?(?![0-9])"
CITE_PAGE_MARK = r"[\s,，]*\b[Pp]{1,2}\.(?:\s*[^\s,，]+)?"
WORD, HEX_WORD = r"[\p{L}]+(?:['’-][\p{L}]+)*", r"[0-9A-Fa-f]{4,}"
EDGE_PUNCTUATION = "\"'’“”()[]{}<>.,;:!?"
PROSE_MIN_TOKENS, PROSE_WORD_FRACTION, HEX_LINE_FRACTION = 3, 0.7, 0.5
NATURAL_WORD_CHARS, NATURAL_WORD_MAX = 2, 15
NO_HITS_SHOWN = 5

#: Identifiers of a request, and the stored fields that hold them.
CODES = ("message_ids", "members", "system_codes")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _given(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)) > 0


def _meets(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def _of(request: str | Column, field: str) -> Column:
    return F.col(f"{request}.{field}") if isinstance(request, str) else request[field]


def in_scope(request: str | Column, chunk: str) -> Column:
    """Product and version, each only where the request names one; an empty name is none."""
    same = lambda f: (F.coalesce(_of(request, f), F.lit("")) == "") | F.coalesce(_of(request, f) == F.col(f"{chunk}.{f}"), F.lit(False))
    return _all([same("product"), same("version")])


def strict(request: str | Column, chunk: str) -> Column:
    """The scope, and of every kind of identifier that the request names at least one in the chunk's own field."""
    doc = ~_given(_of(request, "doc_ids")) | F.array_contains(_of(request, "doc_ids"), F.col(f"{chunk}.doc_no"))
    held = [~_given(_of(request, f)) | _meets(_of(request, f), F.col(f"{chunk}.{f}")) for f in CODES]
    return _all([in_scope(request, chunk), F.coalesce(doc, F.lit(False)), *held])


def relaxed(request: str | Column, chunk: str) -> Column:
    """The scope; a chunk with codes of a kind that the request names must have one of those, one without any stays."""
    fit = lambda f: ~_given(_of(request, f)) | ~_given(F.col(f"{chunk}.{f}")) | _meets(_of(request, f), F.col(f"{chunk}.{f}"))
    return _all([in_scope(request, chunk), fit("message_ids"), fit("system_codes")])


def carries(request: str, chunk: str) -> Column:
    """Whether the chunk holds any identifier that the request names, in its own field."""
    return reduce(lambda a, b: a | b, [_meets(F.col(f"{request}.{f}"), F.col(f"{chunk}.{f}")) for f in CODES])


def same_scope(a: str, b: str) -> Column:
    return F.col(f"{a}.product").eqNullSafe(F.col(f"{b}.product")) & F.col(f"{a}.version").eqNullSafe(F.col(f"{b}.version"))


def leading_title(page_start: Column, title: Column, heading_path: Column) -> Column:
    """A chunk of the section that stands under the document's title on its first page."""
    name = squeezed_edges(title)
    return F.coalesce((page_start == 0) & (name != "") & (squeezed_edges(heading_path) == name), F.lit(False))


def squeezed_edges(text: Column) -> Column:
    """Without white space of any kind at the edges; nothing is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$", "")


def collapsed(text: Column) -> Column:
    return squeezed_edges(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def page_key(page_start: Column, page_label: Column) -> Column:
    """The page's number in the file, or its printed label where there is no number."""
    return F.coalesce(F.concat(F.lit("pdf:"), page_start.cast("string")), page_label)


def skips(stored_sha: Column, sha: Column, stored_rules: Column, rules: Column, status: Column, allow_dry: Column, force: Column) -> Column:
    """A file is skipped if the same content was finished under the same rules and nothing forces it."""
    finished = status.isin("upserted", "skipped") | (allow_dry & (status == "dry"))
    return ~force & F.coalesce(stored_sha == sha, F.lit(False)) & stored_rules.eqNullSafe(rules) & F.coalesce(finished, F.lit(False))


def case_in_scope(scope: Column, behavior: Column, query_class: Column) -> Column:
    """scope is `behavior`, `behavior:class` or `all:class`."""
    wanted, named = F.split_part(scope, F.lit(":"), F.lit(1)), F.regexp_extract(scope, "^[^:]*:(.*)$", 1)
    return ((wanted == "all") | (wanted == behavior)) & ((named == "") | (named == query_class))


def case_passes(o: str) -> Column:
    """Whether a scored outcome meets what its case expects. A case with a critical probe needs a proven safe result."""
    c = lambda n: F.col(f"{o}.{n}")
    yes = lambda n: F.coalesce(c(n), F.lit(False))
    clean = c("critical_failures") == 0
    seen = (
        F.when(c("critical_expected") == "answer", c("completed") & ~c("refused"))
        .when(c("critical_expected") == "refusal", c("completed") & c("refused") & yes("appropriate_abstention") & (c("fabricated") == False))  # noqa: E712
        .otherwise(~c("completed") & ~c("refused"))
    )
    safe = F.when(c("critical_expected").isNull() | c("critical_safe").isNull(), F.lit(False)).otherwise(c("critical_safe") & clean & F.coalesce(seen, F.lit(False)))
    answered = ~c("refused") & yes("useful") & yes("supported") & yes("traceable")
    declined = yes("appropriate_abstention") & F.coalesce(c("fabricated") == False, F.lit(False))  # noqa: E712
    scored = (c("status") == "scored") & c("completed") & clean & (c("critical_probe").isNull() | safe)
    return F.coalesce(scored & F.when(c("expected") == "answer", answered).otherwise(declined), F.lit(False))


def plain_label(label: Column) -> Column:
    """A printed label that is one plain location, else nothing: no comma, page mark or document number, and not long.

    Control and separating characters read as blanks, those that only format vanish.
    """
    text = F.regexp_replace(F.regexp_replace(F.substring(label, 1, 8 * (CITE_LABEL_MAX_CHARS + 1)), r"[\p{Cf}\p{Cs}]", ""), r"[\p{Cc}\p{Zl}\p{Zp}]", " ")
    text = collapsed(text)
    odd = (F.length(text) > CITE_LABEL_MAX_CHARS) | text.rlike("[,，]") | text.rlike(f"(?U){CITE_PAGE_MARK}") | text.rlike(CITE_DOCNO)
    return F.when(odd, "").otherwise(text)


def heading_path(titles: Column) -> Column:
    """Titles joined from the outermost kept one on: whole titles go from the front until the path is short enough."""
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(titles), F.lit(1))), lambda i: F.array_join(F.slice(titles, i, F.greatest(F.size(titles), F.lit(1))), " > "))
    fits = F.filter(tails, lambda p: F.length(p) <= HEADING_PATH_MAX_CHARS)
    return F.coalesce(F.get(fits, F.lit(0)), F.element_at(tails, -1))


def normal_context(text: Column, limit: int) -> Column:
    return F.regexp_replace(F.substring(collapsed(text), 1, limit), " +$", "")


def _tokens(line: Column) -> Column:
    return F.filter(F.split(collapsed(line), " "), lambda t: t != "")


def is_prose(line: Column) -> Column:
    """A line that reads as a sentence of the user's own: enough words, and not mostly capitals."""
    edge = "[" + "".join("\\" + c if c in "[]" else c for c in EDGE_PUNCTUATION) + "]+"
    tokens = _tokens(line)
    words = F.size(F.filter(tokens, lambda t: F.regexp_replace(t, f"^{edge}|{edge}$", "").rlike(f"^(?:{WORD})$")))
    count = lambda p: F.regexp_count(line, F.lit(p))
    return (F.size(tokens) >= PROSE_MIN_TOKENS) & (count(r"\p{Lu}") <= count(r"\p{Ll}")) & (words >= PROSE_WORD_FRACTION * F.size(tokens))


def is_hex(line: Column) -> Column:
    tokens = _tokens(line)
    return (F.size(tokens) > 0) & (F.size(F.filter(tokens, lambda t: t.rlike(f"^(?:{HEX_WORD})$"))) >= HEX_LINE_FRACTION * F.size(tokens))


def verification_state(empty_hits: Column, finish_reason: Column, abstained: Column, has_body: Column, has_script: Column, citations: Column, inferred: Column) -> Column:
    """What a finished answer may claim; the first rule that holds decides."""
    return (
        F.when(empty_hits, "insufficient_evidence")
        .when(~finish_reason.eqNullSafe("stop"), "generation_incomplete")
        .when(abstained, "insufficient_evidence")
        .when(~has_body, F.when(has_script, "unverified_draft").otherwise("generation_incomplete"))
        .when((citations == 0) | inferred, "unverified_draft")
        .otherwise("accepted")
    )


def contains_run(haystack: Column, needle: Column) -> Column:
    """Whether the needle's tokens follow one another in the haystack; an empty needle does everywhere."""
    mark = lambda a: F.concat(F.lit("\x00"), F.array_join(a, "\x00"), F.lit("\x00"))
    return (F.size(needle) == 0) | F.contains(mark(haystack), mark(needle))


def no_hits_message(terms: Column) -> Column:
    """What is said when nothing was found: the identifiers asked for, or that there was nothing."""
    more = F.size(terms) - NO_HITS_SHOWN
    shown = F.concat(F.array_join(F.slice(terms, 1, NO_HITS_SHOWN), ", "), F.when(more > 0, F.concat(F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(""))
    return F.when(F.size(terms) == 0, "No supporting manual excerpts were found for this question.").otherwise(F.concat(F.lit("No manual excerpts carry "), shown, F.lit(".")))


def vendor(path: Column) -> Column:
    """The vendor of the first marker, in their fixed order, that a path below the root holds."""
    low = F.concat(F.lit("/"), F.replace(F.lower(path), F.lit("\\"), F.lit("/")))
    out = F.lit("unknown")
    for marker, name in reversed(VENDOR_MARKERS.items()):
        out = F.when(F.contains(low, F.lit(marker)), name).otherwise(out)
    return out
