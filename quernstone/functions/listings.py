"""Code in manuals: which paragraphs are listings, and their statements, in which no cut may fall."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby, pairwise

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import COLUMNS, TABLE_SHARE

# Job cards, in-stream data, and what makes a listing of a paragraph.
CARD = re.compile(r"//")
OPENS = re.compile(r"//(?:\S|\s\S)")
DATA = re.compile(r"//\S+\s+DD\s+(\*|DATA)(?=[\s,]|$)", re.I)
PROGRAM = re.compile(r"/\*\s*rexx", re.I)
KEYWORD = re.compile(r"\s*(say|do|end|parse|pull|push|queue|exit|return|address|trace|signal|call|select|when|otherwise|nop|drop|interpret)\b", re.I)
ASSIGNMENT = re.compile(r"\s*[A-Za-z_][\w.]*\s*=[^=]")
SHARE, FEWEST_CARDS = 0.6, 2
# A completion code alone on its line, its label, a heading about wait states, the longest entry.
CODE = re.compile(r"[0-9A-F]{3}|U\d{4}")
LABEL = re.compile(r"Explanation\s*(?::|$)", re.I)
WAITS = re.compile(r"\bwait\s+states?\b", re.I)
LONGEST_ENTRY = 3500

#: A card alone whose operands were set on the next line.
WRAPPED = re.compile(r"^[^\S\n]*//[^\S\n]*\n[^\S\n]*((?![/\s])[^\n]*=[^\n]*)$", re.M)
#: What matters in a program outside comments (strings count whole, open ones up to the end), and inside them.
OUTSIDE, INSIDE = re.compile(r"/\*|'[^']*(?:'|\Z)|\"[^\"]*(?:\"|\Z)|;|\n"), re.compile(r"/\*|\*/")


def region(text: str) -> str | None:
    """jcl, rexx, console, or None for prose."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return None
    share = lambda holds: sum(map(bool, map(holds, lines))) / len(lines)
    if share(lambda x: CARD.match(x.lstrip())) >= SHARE or any(DATA.match(x.lstrip()) for x in lines):
        return "jcl"
    opened = any(x.count("/*") > x.count("*/") for x in lines)
    spoken = sum(bool(KEYWORD.match(x)) for x in lines) >= 2 and (";" in text or any(map(ASSIGNMENT.match, lines)))
    if PROGRAM.search(text) or opened or spoken:
        return "rexx"
    return "console" if share(lambda x: x[0].isspace()) >= SHARE else None


def jcl_statements(text: str) -> list[str]:
    """A card with the cards that continue it; every other line by itself."""
    lines = WRAPPED.sub(r"//\1", "\n".join(text.splitlines())).splitlines()
    # s opens a statement, k continues one, d is data, _ is blank
    kinds = "".join("s" if OPENS.match(x.lstrip()) else "k" if CARD.match(x.lstrip()) else "d" if x.strip() else "_" for x in lines)
    return ["\n".join(lines[m.start() : m.end()]).rstrip() for m in re.finditer(r"[sk]k*|d", kinds)]


def _ends(text: str) -> Iterator[tuple[int, str]]:
    """Places after semicolons and at line ends that lie outside comments (which nest) and strings, with the sign found there."""
    at, depth = 0, 0
    while m := (INSIDE if depth else OUTSIDE).search(text, at):
        at = m.end()
        if m[0] in ("/*", "*/"):
            depth += 1 if m[0] == "/*" else -1
        elif m[0] in (";", "\n"):
            yield at, m[0]


def rexx_statements(text: str) -> list[str]:
    """Statements end at semicolons and line ends outside comments and strings; a comma at a line's end goes on with the next."""
    text, made, now, start = "\n".join(text.splitlines()) + "\n", [], "", 0
    for at, sign in _ends(text):
        now, start = now + text[start:at].removesuffix("\n"), at
        if sign == ";" or (now.strip() and not now.strip().endswith(",")):
            made.append(now)
            now = ""
        elif now.strip():
            now += "\n"
    return [s.rstrip() for s in (*made, now + text[start:]) if s.strip()]


def mixed_items(text: str) -> list[tuple[str, bool]]:
    """(text, whole): runs of cards as statements that stay whole, and the prose between them; one item where there are too few cards."""
    lines = text.splitlines()
    if sum(bool(OPENS.match(x.lstrip())) for x in lines) < FEWEST_CARDS:
        return [(text, False)]
    out: list[tuple[str, bool]] = []
    for card, run in groupby(lines, lambda x: bool(CARD.match(x.lstrip()))):
        joined = "\n".join(run)
        out += [(s, True) for s in jcl_statements(joined)] if card else [(joined, False)]
    return [x for x in out if x[0].strip()] or [(text, False)]


def _code_lines(text: str) -> tuple[list[str], list[int]]:
    """Lines, and the places of those that open an entry: a code, and text that is none within two lines."""
    lines = text.splitlines()
    code = [bool(CODE.fullmatch(x.strip())) for x in lines]
    follows = lambda i: next((not code[j] for j in (i + 1, i + 2) if j < len(lines) and lines[j].strip()), False)
    return lines, [i for i, c in enumerate(code) if c and follows(i)]


def code_entries(text: str) -> list[tuple[str, bool]] | None:
    """(text, whole): entries of completion codes, long ones in pieces of whole lines, behind the prose before them; None without any."""
    lines, opens = _code_lines(text)
    if not opens:
        return None
    front = "\n".join(lines[: opens[0]]).strip()
    entries = ["\n".join(lines[a:b]).strip() for a, b in pairwise([*opens, len(lines)])]
    return [(front, False)] * bool(front) + [(p, True) for e in entries for p in capped(e)]


def capped(entry: str, most: int = LONGEST_ENTRY) -> list[str]:
    """Pieces of whole lines, of at most `most` characters; a longer line is a piece by itself."""
    pieces: list[list[str]] = []
    room = -1
    for line in entry.splitlines() if len(entry) > most else [entry]:
        if room - len(line) - 1 < 0:
            pieces.append([])
            room = most + 1
        pieces[-1].append(line)
        room -= len(line) + 1
    return [p for p in ("\n".join(ls).strip() for ls in pieces) if p]


def system_codes(text: str, heading: str) -> list[str]:
    """Codes of a text's entries, each once: user codes as they are, others marked as wait states where the heading says so."""
    lines, opens = _code_lines(text)
    mark = "W" if WAITS.search(heading) else ""
    found = (lines[i].strip().upper() for i in opens)
    return list(dict.fromkeys(c if c.startswith("U") else mark + c for c in found))


def is_code_section(text: str) -> bool:
    """Whether a code is directly followed by its label, blank lines aside."""
    return any(CODE.fullmatch(a) and LABEL.match(b) for a, b in pairwise([x.strip() for x in text.splitlines() if x.strip()]))


def is_table(text: str) -> bool:
    lines = [x for x in text.splitlines() if x.strip()]
    return region(text) is None and len(lines) > 0 and sum(bool(re.search(COLUMNS, x)) for x in lines) >= TABLE_SHARE * len(lines)


def prose_or_table(text: str) -> list[tuple[str, bool]]:
    """(text, whole): rows of a table, or cards and the prose between them."""
    return [(x, True) for x in text.splitlines() if x.strip()] if is_table(text) else mixed_items(text)


def statements(text: str, with_codes: bool = True) -> list[tuple[str, bool]]:
    """(text, whole): a paragraph's units that no cut may fall into, or the paragraph itself as prose."""
    kind = region(text)
    if kind in ("jcl", "rexx"):
        units = (jcl_statements if kind == "jcl" else rexx_statements)(text)
    else:
        units = [x for x in text.splitlines() if x.strip()] if kind else []
    entries = code_entries(text) if with_codes and not units else None
    return [(s, True) for s in units] or entries or prose_or_table(text)


UNITS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("whole", T.BooleanType())]))


def units_udf(split: Callable[[str], list]) -> Callable:
    """A pandas function of texts that gives (text, whole) units; a null text, or None from the splitter, gives null."""

    @F.pandas_udf(UNITS)
    def run(text: pd.Series) -> pd.Series:
        of = lambda t: [{"text": u[0], "whole": u[1]} if isinstance(u, tuple) else {"text": u, "whole": True} for u in t]
        return text.map(lambda t: None if t is None or (found := split(t)) is None else of(found))

    return run


@F.pandas_udf(T.StringType())
def region_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else region(t))


@F.pandas_udf(T.StructType([T.StructField("codes", T.ArrayType(T.StringType())), T.StructField("labelled", T.BooleanType())]))
def codes_of(text: pd.Series, heading: pd.Series) -> pd.DataFrame:
    rows = [(system_codes(t or "", h or ""), is_code_section(t or "")) for t, h in zip(text, heading, strict=True)]
    return pd.DataFrame(rows, columns=["codes", "labelled"])
