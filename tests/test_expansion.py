"""Reading runs and slots against a walk hit by hit over small corpora."""

import random

import pytest

from quernstone.operators import expansion as E

CHUNK = "chunk_id long, rev string, section string, ordinal int, page_start int, page_end int, product string, version string, ids array<string>"
HIT = "request long, rank int, chunk_id long, product string, version string, named array<string>"


def order_of(page, near, last_page):
    """The page's chunks in reading order, or None."""
    here = [c for c in near if c[4] == page]
    groups = {}
    for s in {c[2] for c in here}:
        every = [c for c in near if c[2] == s]
        if len({c[3] for c in every}) < len(every) or any(c[3] is None or not 0 <= c[3] < E.ORDINALS for c in every):
            return None
        own = sorted((c for c in here if c[2] == s), key=lambda c: c[3])
        past = any(c[4] > page or (c[5] is not None and c[5] > page) for c in every)
        ends = page < last_page and all(c[5] is not None and c[5] <= page for c in every)
        groups.setdefault("on" if own[0][3] else "past" if past else "ends" if ends else "open", []).append(own)
    starts = [k for k in groups if k != "on" for _ in groups[k]]
    if len(groups.get("on", [])) > 1 or (len(starts) > 1 and sorted(starts) != ["ends", "past"]):
        return None
    return [c for k in ("on", "ends", "open", "past") for g in groups.get(k, []) for c in g]


def walk(hit, chunks, cap):
    """(list of (offset, chunk), stopped) of one hit."""
    own = next((c for c in chunks if c[0] == hit[2]), None)
    near = [] if own is None else [c for c in chunks if c[1] == own[1] and abs(c[4] - own[4]) <= E.PAGES]
    if own is None or len(near) > E.WINDOW or any(c[2] is None for c in near):
        return [], 2
    pages = sorted({c[4] for c in near})
    orders = {p: order_of(p, near, own[4] + E.PAGES) for p in pages}
    if orders[own[4]] is None:
        return [], 2
    line = [(c, True) for p in pages for c in (orders[p] or [])] if all(orders.values()) else [x for p in pages for x in ([(c, True) for c in orders[p]] if orders[p] else [(None, False)])]
    at = next(i for i, (c, _) in enumerate(line) if c is not None and c[0] == own[0])
    out, stopped = {1: [], -1: []}, 0
    for step in (1, -1):
        i = at
        while len(out[step]) < cap and 0 <= i + step < len(line):
            a, b = (line[i][0], line[i + step][0]) if step == 1 else (line[i + step][0], line[i][0])
            new = line[i + step][0]
            fits = new is not None and b[3] == (a[3] + 1 if a[2] == b[2] else 0) and new[6:8] == own[6:8] and all(w in (None, "") or w == v for w, v in zip(hit[3:5], own[6:8], strict=True))
            if not fits:
                stopped += 1
                break
            out[step].append(new)
            i += step
    near_first = sorted([(s * (k + 1), c) for s in (1, -1) for k, c in enumerate(out[s])], key=lambda x: (abs(x[0]), -x[0]))
    return near_first[:cap], stopped


def brute(hits, chunks, cap, budget):
    kept, outcome = [], []
    for request in sorted({h[0] for h in hits}):
        mine = sorted((h for h in hits if h[0] == request), key=lambda h: h[1])
        found = [walk(h, chunks, cap) for h in mine]
        held, taken, cut, skipped = {h[2] for h in mine}, [], 0, 0
        for k in range(cap):
            for h, (run, _) in zip(mine, found, strict=True):
                if k >= len(run) or run[k][1][0] in held:
                    continue
                if h[5] is not None and not set(h[5]) & set(run[k][1][8] or []):
                    skipped += 1
                elif len(taken) >= budget:
                    cut += 1
                else:
                    held.add(run[k][1][0])
                    taken.append((request, h[1], run[k][0], run[k][1][0]))
        kept += [(*t, i) for i, t in enumerate(sorted(taken, key=lambda t: t[1:3]), 1)]
        outcome.append((request, len(taken), len({t[1] for t in taken}), sum(s for _, s in found), cut, None if mine[0][5] is None else skipped))
    return sorted(kept), outcome


def corpus(seed):
    rng, chunks = random.Random(seed), []
    for r in range(12):
        page, k = 0, 0
        for s in range(rng.randrange(2, 9)):
            name = f"S{rng.randrange(3) if rng.random() < 0.3 else s + 10}"
            for o in range(rng.choice([1, 1, 2, 4, 30 if r == 3 else 3])):
                end = page + (rng.random() < 0.3)
                chunks.append((100 * r + k, f"r{r}", None if rng.random() < 0.005 else name, o + (rng.random() < 0.03), page, None if rng.random() < 0.08 else end, rng.choice(["P"] * 9 + [None]), "V", rng.choice([None, [], ["a"], ["a", "b"]])))
                page, k = end + (rng.random() < 0.25) * rng.choice([1, 1, 3]), k + 1
    ids = [c[0] for c in chunks] + [10**6]
    hits = [(q, k, i, rng.choice([None, "", "P", "Q"] if q % 4 == 0 else [None]), rng.choice([None, "V"]), [None, ["a"], ["b", "c"]][q % 3]) for q in range(40) for k, i in enumerate(rng.sample(ids, 4) + rng.sample(ids[:12], 2))]
    return hits, chunks


@pytest.mark.parametrize(("seed", "cap", "budget"), [(1, 4, 8), (2, 3, 2), (3, 1, 16)])
def test_expansion_equals_a_walk(spark, seed, cap, budget):
    hits, chunks = corpus(seed)
    kept, outcome = E.expanded(spark.createDataFrame(hits, HIT), spark.createDataFrame(chunks, CHUNK), cap, budget)
    want = brute(hits, chunks, cap, budget)
    assert sorted(map(tuple, kept.collect())) == want[0] and len(want[0]) > 20
    assert sorted(map(tuple, outcome.collect())) == want[1]


def test_two_sections_begin_on_a_page_only_where_one_ends_there(spark):
    """The page before is seen whole; the one at the window's edge can't show that a section ends."""
    chunks = [(1, "r", "A", 0, 1, 1, None, None, None), (2, "r", "B", 0, 1, 2, None, None, None), (3, "r", "B", 1, 2, 2, None, None, None), (4, "r", "C", 0, 3, 3, None, None, None), (5, "r", "D", 0, 3, 4, None, None, None)]
    made = E.expanded(spark.createDataFrame([(0, 0, 2, None, None, None), (1, 0, 3, None, None, None)], HIT), spark.createDataFrame(chunks, CHUNK), 4, 9)
    assert sorted(map(tuple, made[0].collect())) == [(0, 0, -1, 1, 1), (0, 0, 1, 3, 2), (1, 0, -2, 1, 1), (1, 0, -1, 2, 2), (1, 0, 1, 4, 3), (1, 0, 2, 5, 4)]
    assert sorted(map(tuple, made[1].collect())) == [(0, 2, 1, 1, 0, None), (1, 4, 1, 0, 0, None)]
