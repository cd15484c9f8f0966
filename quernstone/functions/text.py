"""Column builders over text: identifiers, kinds of chunks, citations, prices and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of identifiers.
DOCNO = r"\b([A-Z]{2,4}\d{2}-\d{4}(?:-\d{2})?)\b"
MESSAGE = r"\b([A-Z]{3}\d{2,5}[A-Z]|DFH[A-Z]{0,2}\d{4,5}|DFS\d{3,4}[A-Z]?|[A-Z]{4}\d{2,5}[A-Z])\b"
MEMBER = r"\b([A-Z]{3,8}(?:xx|\d{2}))\b"
MEMBER_TYPED = r"\b([A-Za-z]{3,8}(?:[xX]{2}|\d{2}))\b"
MESSAGE_LINE = r"^\s*(?:[A-Z]{3}\d{2,5}[A-Z]|DFH[A-Z]{0,2}\d{4,5}|DFS\d{3,4}[A-Z]?|[A-Z]{4}\d{2,5}[A-Z])"
SYNTAX = r"(::=|>>-|>>\+|<--|--\+|-\+-|--\\-)"
PARAMETER = r"<[a-zA-Z][\w-]*>"
BOX = "─│┌┐└┘├┤┬┴┼━┃┏┓┗┛"
SCAN_LINES, TABLE_SHARE = 6, 0.6
# Whether two or more blanks stand between other characters; which characters are in the columns doesn't matter.
COLUMNS = r"\S\s{2,}\S"
#: Ends of lines and white space of all kinds.
LINE_END = r"[\x0a-\x0d\x1c-\x1e\x85\u2028\u2029]"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def all_of(text: Column, pattern: str) -> Column:
    """Sorted distinct matches."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))


def text_lines(text: Column) -> Column:
    """Lines that aren't blank, whatever ends them and whatever white space they hold."""
    return F.filter(F.split(text, LINE_END), lambda x: x.rlike(f"[^{SPACE[1:]}"))


def is_table(text: Column) -> Column:
    rows = text_lines(text)
    return (F.size(rows) > 0) & (F.size(F.filter(rows, lambda x: x.rlike(COLUMNS))) >= TABLE_SHARE * F.size(rows))


def chunk_type(text: Column) -> Column:
    """message, syntax, table or narrative, by the first rule that fits."""
    rows = text_lines(text)
    head = F.exists(F.slice(rows, 1, SCAN_LINES), lambda x: F.regexp_replace(x, f"^{SPACE}+", "").rlike(MESSAGE_LINE))
    many = lambda p: F.size(F.filter(rows, lambda x: x.rlike(p))) >= 2
    syntax = F.contains(text, F.lit("::=")) | many(f"[{BOX}]") | many(SYNTAX) | text.rlike(PARAMETER)
    return F.when(F.size(rows) == 0, "narrative").when(head, "message").when(syntax, "syntax").when(is_table(text), "table").otherwise("narrative")


#: The same by arrays of DuckDB, whose patterns have no class for all white space.
_BLANK = "\\s\\v\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
CHUNK_TYPE_SQL = f"""
SELECT doc_id, CASE WHEN coalesce(len(ls), 0) = 0 THEN 'narrative'
 WHEN len(list_filter(ls[1:{SCAN_LINES}], lambda x: regexp_matches(x, '^[{_BLANK}]*{MESSAGE_LINE[4:]}'))) > 0 THEN 'message'
 WHEN contains(text, '::=') OR len(list_filter(ls, lambda x: regexp_matches(x, '[{BOX}]'))) >= 2 OR len(list_filter(ls, lambda x: regexp_matches(x, '{SYNTAX}'))) >= 2 OR regexp_matches(text, '{PARAMETER}') THEN 'syntax'
 WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{COLUMNS}'))) >= {TABLE_SHARE} * len(ls) THEN 'table' ELSE 'narrative' END AS chunk_type
FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '[\\n\\v\\f\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS ls FROM documents)"""
