"""Sections against ownership character by character, blocks against what they must keep."""

import random

import pytest

from quernstone.functions import listings as L
from quernstone.functions import sections as S
from quernstone.operators import sectioning
from quernstone.plans import books

DATA = "/root/testdata/sf0.001"
key = lambda t: " ".join(t.split()).casefold()


def owners(title, texts, outline):
    """The heading that owns each character, page by page; None for skipped pages."""
    n = len(texts)
    front = max(2, int(0.15 * n))
    skip = lambda t, p: t.lower() in ("contents", "figures") and p <= front or t.lower().endswith(("index", "notices"))
    by_page = sorted([(lv, " ".join(t.split()), p) for lv, t, p in outline], key=lambda e: e[2])
    kept = [e for e in by_page if e[1] and not skip(e[1], e[2])]
    heads, stack = [], []
    for lv, t, _ in kept:
        while stack and stack[-1][0] >= lv:
            stack.pop()
        stack.append((lv, t))
        heads.append(" > ".join(x for _, x in stack))
    out, current = [], None
    for page, text in enumerate(texts):
        here = [k for k, e in enumerate(kept) if max(0, e[2] - 1) == page]
        if not here:
            if current is None:
                before = [e for e in by_page if e[2] <= page + 1]
                gone = page < front and before and skip(before[-1][1], before[-1][2])
                out.append([None if gone else title] * len(text))
            else:
                out.append([current] * len(text))
            continue
        current = heads[here[-1]]
        out.append([current] * len(text))
        own = [here[0], *(k for k in here[1:] if sum(key(e[1]) == key(kept[k][1]) for e in kept) == 1)]
        spots, at = [0], -1
        for k in own[1:]:
            want = key(kept[k][1])
            at = next((i for i in range(at + 1, len(text)) if (i == 0 or text[i - 1] == "\n") and (key(text[i:].split("\n")[0]) + " ").startswith(want + " ")), None)
            if at is None:
                break
            spots.append(at)
        if at is None or len(own) == 1:
            continue
        # from the last part back: a part that gives its text to the next takes that one's heading
        names, nxt = [None] * len(own), None
        for j in range(len(own) - 1, -1, -1):
            body = text[spots[j] : spots[j + 1] if j + 1 < len(own) else len(text)]
            rest = [x for x in body.split("\n") if x.strip() and key(x) != key(kept[own[j]][1])]
            gives = j + 1 < len(own) and (kept[own[j + 1]][0] > kept[own[j]][0] or not rest)
            names[j] = names[j + 1] if gives else heads[own[j]]
            nxt = nxt or names[j]
        parts = [x for j, x in enumerate(names) if not j or names[j - 1] != x]
        if len(set(parts)) < len(parts) or len(parts) < 2:
            continue
        out[-1] = [names[max(j for j, s in enumerate(spots) if s <= i)] for i in range(len(text))]
        current = names[-1]
    return out


def test_outlines_own_every_character_as_by_hand():
    rng = random.Random(6)
    words = ["Start", "Stop it", "Syntax", "WID001I", "WID002I", "Contents", "Notices", "Reference index", "", *(f"CMD{k}" for k in range(9))]
    shared = 0
    for _ in range(3000):
        n = rng.randrange(1, 7)
        texts = ["\n".join(rng.choice([*words, "plain text", "start  now", "  "]) for _ in range(rng.randrange(7))) for _ in range(n)]
        outline = [(rng.randrange(1, 4), rng.choice(words), rng.randrange(1, n + 2)) for _ in range(rng.randrange(1, 7))]
        if rng.random() < 0.5:  # entries in the order of the pages' own lines
            outline = [(rng.randrange(1, 3), x, p + 1) for p, t in enumerate(texts) for x in t.split("\n") if rng.random() < 0.6] or outline
        found = S.outlined("Book", n, [S.Entry(*e) for e in outline], dict(enumerate(texts)))
        mine = [[None] * len(t) for t in texts]
        for s in found:
            for page in range(s.start, min(s.end, n)):
                a, b = (s.first, s.until) if page == s.start else (0, None)
                mine[page][a : len(mine[page]) if b is None else b] = [s.heading] * (len(mine[page][a:]) if b is None else b - a)
        assert mine == owners("Book", texts, outline), (texts, outline)
        shared += any(s.until for s in found)
    assert shared > 100


def test_books_without_outline_and_long_paths():
    made = S.windowed("B", ["x", "Chapter 1", "", "2.1 Two", *["y"] * 12])
    assert made == [("B", 0, 1, 0, None), ("B > Chapter 1", 1, 3, 0, None), ("B > 2.1 Two", 3, 13, 0, None), ("B", 13, 16, 0, None)]
    assert S.windowed("B", []) == []
    assert S.paths([S.Entry(1, "a" * 300, 1), S.Entry(2, "b" * 200, 1), S.Entry(3, "c" * 100, 1)])[-1] == "b" * 200 + " > " + "c" * 100


def units(rng, n):
    return [S.Item(k // 3, (f"u{k} " + "x" * rng.choice([3, 20, 60, 130])).strip(), rng.random() < 0.5) for k in range(n)]


def test_blocks_keep_every_unit_and_cut_no_whole_one():
    rng = random.Random(7)
    for _ in range(800):
        given = units(rng, rng.randrange(1, 25))
        made = list(S.blocks(given, 100, 30))
        for item in given:
            holders = [b for b in made if item.text in b.text]
            if item.whole or len(item.text) <= 100:
                assert holders and all(b.start <= item.page <= b.end for b in holders[:1]), item
            else:
                assert item.text in "".join(b.text for b in made if b.start == b.end == item.page and not b.units)
        for b in made:
            whole = [b.text[a:z] for a, z, w in b.units if w]
            assert all(t in {i.text for i in given if i.whole} for t in whole)
            assert all(a2 - z1 == (1 if w1 and w2 else 2) for (_, z1, w1), (a2, _, w2) in zip(b.units, b.units[1:], strict=False))
        for b, c in zip(made, made[1:], strict=False):
            if b.units and c.units and not c.units[0][2]:
                seed = c.text[: c.units[0][1]]
                assert b.text.endswith(seed) or seed in {i.text for i in given}


def test_blocks_by_hand():
    p = lambda n, page=0, whole=False: S.Item(page, "abcdefghij"[n % 10] * n, whole)
    assert [b.text for b in S.blocks([p(60), p(50, 1)], 100, 10)] == ["a" * 60, "a" * 10 + "\n\n" + "a" * 50]
    assert [b.text for b in S.blocks([p(61, 0, True), p(52, 1, True)], 100, 10)] == ["b" * 61, "c" * 52]  # no cut into a listing
    assert [b.text for b in S.blocks([p(61, 0, True), p(5, 1, True), p(52, 1, True)], 100, 10)] == ["b" * 61 + "\n" + "f" * 5, "f" * 5 + "\n" + "c" * 52]
    assert [(b.start, b.end, len(b.text)) for b in S.blocks([p(5), p(250, 1), p(120, 2, True)], 100, 10)] == [(0, 0, 5), (1, 1, 100), (1, 1, 100), (1, 1, 50), (2, 2, 120)]


def test_records_stay_whole_until_a_sentence():
    found = list(S.items([(0, "//A DD *\nrec 1"), (0, "rec 2\nrec 3"), (1, "It ends here.\nreally"), (1, "rec 4")], False))
    assert [(i.text, i.whole) for i in found] == [("//A DD *", True), ("rec 1", True), ("rec 2", True), ("rec 3", True), ("It ends here.\nreally", False), ("rec 4", False)]
    codes = [(0, "intro\n0C4\nfails"), (1, "Explanation: x")]
    assert [i.whole for i in S.items(codes, True)] == [False, True, False] and [i.whole for i in S.items(codes, False)] == [False, False]


def test_queries_equal_the_functions(spark):
    shop, outline, pages = (x.collect() for x in books.records(spark, DATA))
    found = {(r.book, r.nth): tuple(r)[2:] for r in books.sections(spark, DATA).collect()}
    rows = {}
    for b in shop:
        texts = [r.text or "" for r in sorted((r for r in pages if r.book == b.book), key=lambda r: r.page)]
        entries = [S.Entry(r.level, r.title, r.page) for r in sorted((r for r in outline if r.book == b.book), key=lambda r: r.nth)]
        leads = [next((x.strip() for x in t.splitlines() if x.strip()), "") for t in texts]
        made = S.outlined(b.title, len(texts), entries, dict(enumerate(texts))) if entries else S.windowed(b.title, leads)
        rows |= {(b.book, k): tuple(s) for k, s in enumerate(made)}
    assert found == rows and any(r[4] for r in rows.values())
    by_book = {}
    for r in pages:
        by_book.setdefault(r.book, {})[r.page] = r.text or ""
    made = sectioning.chunked(books.sections(spark, DATA), spark.createDataFrame([tuple(r) for r in pages], "book long, page int, text string")).collect()
    for k, s in rows.items():
        texts = [(p, by_book[k[0]][p][s[3] : s[4]] if p == s[1] else by_book[k[0]][p]) for p in range(s[1], s[2])]
        want = [(b.start, b.end, b.text) for b in S.section_blocks(texts)]
        assert [(r.page_start, r.page_end, r.text) for r in sorted((r for r in made if (r.book, r.nth) == k), key=lambda r: r.ordinal)] == want
    assert L.statements("x") == [("x", False)]


@pytest.mark.parametrize("text", ["", "\n \n"])
def test_nothing_makes_no_block(text):
    assert S.section_blocks([(0, text)]) == []
