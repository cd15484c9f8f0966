"""Coverage against a comparison of every item with every title."""

import random
import re

from quernstone.operators import coverage as C

ITEM = "id long, match string, numbers array<string>, groups array<array<string>>, prefixes array<string>, expect_many boolean"


def norm(t):
    return " ".join((t or "").replace("’", "").replace("'", "").lower().split())


def fam(d):
    m = re.fullmatch(r"(REDP\d{4}|[A-Z]{2,4}\d{6})(?:\d{2})?", d.replace("-", "").upper())
    return m[1] if m else d


def brute(items, titles):
    out = {}
    for i, match, numbers, groups, prefixes, many in items:
        wanted = {n.replace("-", "") for n in numbers or []}
        hits = {d for d, _ in titles if fam(d) in wanted}
        if hits:
            out[i] = ("present", "doc_number", len(hits), len(hits))
            continue
        holds = lambda k, t: re.search(r"(?<![0-9a-z])" + re.escape(norm(k)) + r"(?![0-9a-z])", t)
        hits = {d for d, t in titles if (not prefixes or d.upper().startswith(tuple(p.upper() for p in prefixes))) and any(all(holds(k, norm(t)) for k in g) for g in groups or [])}
        clear = match == "title" and (len({fam(d) for d in hits}) == 1 or many)
        out[i] = ("present" if hits and clear else "ambiguous" if hits else "missing", "title" if hits else None, len(hits), sum(bool(re.fullmatch(r"(?i:SG24|REDP)-?\d{4}(?:-?\d{2})?", d)) for d in hits))
    return out


def test_coverage_equals_all_pairs(spark):
    rng = random.Random(5)
    words = ["job", "control", "user’s", "Users'", "guide", "c++", "c", "z/os", "日本", "日", "a.b", "\\E", "ref", "JOB", "jobs", "2", "  "]
    titles = [(rng.choice([f"SC23-{k % 40:04d}-0{k % 3}", f"sg24-{k % 25:04d}", f"REDP{k % 9:04d}", f"stem-{k}"]), None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(5)))) for k in range(300)]
    words = [w for w in words if w.strip() and w != "\\E"]
    items = [(i, rng.choice(["title", "doc_number"]), rng.choice([None, [], [f"SC23-{rng.randrange(60):04d}"], [f"SG24-{rng.randrange(99):04d}", "REDP-0003"]]), rng.choice([None, [[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 3))]]), rng.choice([None, None, ["s"], ["RE", "st"]]), rng.random() < 0.3) for i in range(200)]
    made = C.covered(spark.createDataFrame(items, ITEM), spark.createDataFrame(titles, "doc_id string, title string"))
    assert {r.id: tuple(r)[1:] for r in made.collect()} == brute(items, titles)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_items_without_a_catalog_are_missing(spark):
    made = C.covered(spark.createDataFrame([(1, "title", None, [["a"]], None, None)], ITEM), spark.createDataFrame([], "doc_id string, title string"))
    assert [tuple(r) for r in made.collect()] == [(1, "missing", None, 0, 0)]
