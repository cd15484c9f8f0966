"""Sections of books by their outline, and blocks of a section's paragraphs."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby, pairwise
from typing import NamedTuple

from . import listings

# Headings without content of their own; a block's size and what the next one repeats; a heading path's length.
BACK_MATTER = re.compile(r"(notices?|trademarks?|reader'?s comments|bibliography|copyright|index)\s*$", re.I)
FRONT_MATTER = re.compile(r"^(contents|figures|tables|summary of changes)$", re.I)
FRONT_SHARE, FRONT_PAGES = 0.15, 2
BLOCK, OVERLAP, PATH = 3500, 400, 512
# What opens a section of a book without an outline, how many pages one has, how long its heading is.
LEAD = re.compile(r"^\s*(?:\d+(?:\.\d+)+\s+\S|(?:chapter|appendix|section)\b)", re.I)
WINDOW, LEAD_CHARS = 10, 100
# Fixed value: lines of records don't end like sentences.
SPOKEN = re.compile(r"[.?!:]\s*$")


class Section(NamedTuple):
    """Pages from start up to end; on the first of them the characters from first up to until (null: all)."""

    heading: str
    start: int
    end: int
    first: int = 0
    until: int | None = None


class Entry(NamedTuple):
    level: int
    title: str
    page: int  # from 1


class Item(NamedTuple):
    page: int
    text: str
    whole: bool


def squeezed(text: str) -> str:
    return " ".join(text.split())


def skipped(entry: Entry, front: int) -> bool:
    """Back matter anywhere, front matter on the first pages."""
    return bool(BACK_MATTER.search(entry.title)) or (entry.page <= front and bool(FRONT_MATTER.search(entry.title)))


def paths(entries: list[Entry]) -> list[str]:
    """Each entry under those above it; outer ones go while the path is too long."""
    above: list[Entry] = []
    out = []
    for e in entries:
        above = [*(a for a in above if a.level < e.level), e]
        titles = [a.title for a in above]
        while len(titles) > 1 and len(" > ".join(titles)) > PATH:
            titles = titles[1:]
        out.append(" > ".join(titles))
    return out


def aligned(titles: list[str], page: str) -> list[int] | None:
    """Where lines that open with the titles begin, one after another; None if one isn't found after those before it."""
    lines = page.splitlines(keepends=True)
    at = list(zip(accumulate(map(len, lines), initial=0), (squeezed(x).casefold() for x in lines), strict=False))
    found: list[int] = []
    for title in titles:
        want = squeezed(title).casefold()
        spot = next((o for o, x in at if x and (x == want or x.startswith(f"{want} ")) and (not found or o > found[-1])), None)
        if spot is None:
            return None
        found.append(spot)
    return found


def shared_page(group: list[tuple[Entry, str]], page: str, unique: set[str]) -> list[tuple[str, int]] | None:
    """(path, first character) of the parts of a page that several entries begin on; None to leave it whole. Only titles that the
    outline has once divide it. A part without text of its own, or before a deeper entry, belongs to the next."""
    group = [g for k, g in enumerate(group) if not k or g[0].title.casefold() in unique]
    spots = aligned([e.title for e, _ in group[1:]], page)
    if spots is None:
        return None
    parts: list[tuple[str, int]] = []
    begin = 0
    for k, ((entry, path), start, stop) in enumerate(zip(group, [0, *spots], [*spots, len(page)], strict=True)):
        own = any(x.strip() and squeezed(x).casefold() != entry.title.casefold() for x in page[start:stop].splitlines())
        if k + 1 < len(group) and (group[k + 1][0].level > entry.level or not own):
            continue
        parts.append((path, begin))
        begin = stop
    return parts if len({p for p, _ in parts}) == len(parts) > 1 else None


def outlined(title: str, pages: int, outline: Iterable[Entry], shared: dict[int, str]) -> list[Section]:
    """Sections of a book with an outline. shared: the texts of pages (from 0) on which several entries begin."""
    front = max(FRONT_PAGES, int(FRONT_SHARE * pages))
    entries = sorted((e._replace(title=squeezed(e.title)) for e in outline), key=lambda e: e.page)
    kept = [e for e in entries if e.title and not skipped(e, front)]
    first_kept = min(pages, max(0, kept[0].page - 1)) if kept else pages
    starts = [e.page for e in entries]

    def bare(page: int) -> bool:
        k = bisect_right(starts, page + 1) - 1
        return page < front and k >= 0 and skipped(entries[k], front)

    out = []
    for dropped, run in groupby(range(first_kept), bare):
        own = list(run)
        if not dropped:
            out.append(Section(title, own[0], own[-1] + 1))
    times = Counter(e.title.casefold() for e in kept)
    unique = {t for t, n in times.items() if n == 1}
    groups = [(start, list(g)) for start, g in groupby(zip(kept, paths(kept), strict=True), lambda g: max(0, g[0].page - 1))]
    for (start, group), (end, _) in pairwise([*groups, (pages, [])]):
        if end <= start:
            continue
        parts = shared_page(group, shared[start], unique) if len(group) > 1 and start in shared else None
        if parts is None:
            out.append(Section(group[-1][1], start, end))
            continue
        for (path, at), (_, to) in pairwise(parts):
            out.append(Section(path, start, start + 1, at, to))
        out.append(Section(parts[-1][0], start, end, parts[-1][1]))
    return out


def windowed(title: str, leads: list[str]) -> list[Section]:
    """Sections of a book without an outline, by the first line that isn't blank of each page."""
    starts = [0]
    for page, lead in enumerate(leads):
        if page and (LEAD.match(lead) or page - starts[-1] >= WINDOW):
            starts.append(page)
    named = lambda p: f"{title} > {squeezed(leads[p])[:LEAD_CHARS]}" if p and LEAD.match(leads[p]) else title
    return [Section(named(a), a, b) for a, b in pairwise([*starts, len(leads)]) if b > a]


def items(paragraphs: Iterable[tuple[int, str]], with_codes: bool) -> Iterator[Item]:
    """(page, text, whole) units of (page, text) paragraphs. Records after an in-stream card stay whole by line until a sentence comes."""
    records = False
    for page, text in paragraphs:
        lines = [x for x in text.splitlines() if x.strip()]
        coded = listings.region(text) is not None
        other = coded or (with_codes and listings.code_entries(text)) or listings.is_table(text)
        if records and lines and not other:
            records = not any(map(SPOKEN.search, lines))
            units = [(x, True) for x in lines] if records else [(text, False)]
        else:
            units = listings.statements(text, with_codes)
            records = coded and any(listings.DATA.match(x.lstrip()) for x in text.splitlines())
        yield from (Item(page, t, whole) for t, whole in units)


class Block(NamedTuple):
    start: int  # first page
    end: int  # last page
    text: str
    units: list[tuple[int, int, bool]]


def joined(held: list[Item]) -> Block:
    """Units of listings by lines, others by blank lines."""
    text, units = "", []
    for k, item in enumerate(held):
        text += ("\n" if item.whole and held[k - 1].whole else "\n\n") if k else ""
        units.append((len(text), len(text) + len(item.text), item.whole))
        text += item.text
    return Block(min(i.page for i in held), max(i.page for i in held), text, units)


def repeated(held: list[Item], block: Block, overlap: int) -> list[Item]:
    """What the next block begins with: the end of this one, or whole units where that would cut one."""
    at = len(block.text) - overlap
    torn = next((k for k, (a, b, whole) in enumerate(block.units) if whole and a < at < b), None)
    return [Item(held[-1].page, block.text[max(0, at) :], False)] if torn is None else held[torn + 1 :]


def blocks(units: Iterable[Item], size: int = BLOCK, overlap: int = OVERLAP) -> Iterator[Block]:
    """Blocks of about `size` characters. A longer unit is a block by itself if it is whole, else cut into pieces of that size."""
    held: list[Item] = []
    used = 0
    for item in units:
        n = len(item.text)
        if n > size:
            if held:
                yield joined(held)
            held, used = [], 0
            if item.whole:
                yield joined([item])
            else:
                yield from (Block(item.page, item.page, item.text[k : k + size], []) for k in range(0, n, size))
            continue
        if held and used + n > size:
            block = joined(held)
            yield block
            seed = repeated(held, block, overlap)
            held = [*seed, item]
            # a seed of running text counts one gap, others as many as there are units
            used = sum(len(i.text) for i in held) + 2 * (1 if len(seed) == 1 and not seed[0].whole else len(held))
        else:
            held.append(item)
            used += n + 2
    if held:
        yield joined(held)


def section_blocks(pages: Iterable[tuple[int, str]]) -> list[Block]:
    """Blocks of a section's pages (number, text)."""
    paragraphs = [(n, p.strip()) for n, text in pages for p in re.split(r"\n\s*\n", text) if p.strip()]
    coded = listings.is_code_section("\n".join(p for _, p in paragraphs))
    return list(blocks(items(paragraphs, coded)))
