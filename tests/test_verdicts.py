"""Intervals against resamples drawn one by one, and verdicts on records made by hand."""

import math
import random

import pytest

from quernstone.operators import gates, resampling
from quernstone.plans import registry, verdicts


def count(key, b, seed):
    """How often a row counts, in whole numbers of Python."""
    x = (key * resampling.KEY + b * resampling.RESAMPLE + seed * resampling.SEED) % 2**64
    x = (x ^ x >> 30) * resampling.MIX[0] % 2**64
    x = (x ^ x >> 27) * resampling.MIX[1] % 2**64
    u = ((x ^ x >> 31) >> 32) / 2**32
    n, chance = 0, math.exp(-1)
    while u >= chance and n < 12:
        n += 1
        chance += math.exp(-1) / math.factorial(n)
    return n


def drawn(rows, resamples, seed):
    out = []
    for b in range(resamples):
        held = [(v, count(k, b, seed)) for k, v in rows]
        if total := sum(n for _, n in held):
            out.append(sum(v * n for v, n in held) / total)
    return sorted(out)


def test_intervals_equal_resamples_one_by_one(spark):
    rng = random.Random(1)
    rows = [(g, k, rng.random()) for g, n in (("a", 40), ("b", 3), (None, 2)) for k in rng.sample(range(-(10**9), 10**12), n)] + [("a", 5, None), ("c", 6, None)]
    df = spark.createDataFrame(rows, "g string, k long, v double").repartition(7)
    for nearest in (False, True):
        found = {r.g: r for r in resampling.interval(df, "g", "k", "v", 300, 9, 0.1, nearest).collect()}
        assert set(found) == {"a", "b", "c", None} and found["c"].lo is None and found["c"].n == 0
        for g in ("a", "b", None):
            own = [(k, v) for x, k, v in rows if x == g and v is not None]
            means = drawn(own, 300, 9)
            at = lambda q: means[min(len(means) - 1, int(q * len(means)))] if nearest else means[int(q * (len(means) - 1))] + (q * (len(means) - 1) % 1) * (means[min(len(means) - 1, int(q * (len(means) - 1)) + 1)] - means[int(q * (len(means) - 1))])  # noqa: E731, B023
            assert (found[g].n, found[g].mean) == (len(own), pytest.approx(sum(v for _, v in own) / len(own)))
            assert (found[g].lo, found[g].hi) == (pytest.approx(at(0.05)), pytest.approx(at(0.95)))


def test_poisson_counts_have_mean_and_variance_of_one():
    got = [count(k, b, 3) for k in range(300) for b in range(40)]
    mean = sum(got) / len(got)
    assert abs(mean - 1) < 0.03 and abs(sum((x - mean) ** 2 for x in got) / len(got) - 1) < 0.05


ROW = "run long, entry long, class string, recall_1 double, recall_5 double, mrr double"


def test_promotion_names_every_reason(spark):
    base = [(r, e, "ab"[e % 2], 1.0, 0.5, 0.5) for r in (1, 2, 3, 4) for e in range(60)]
    new = [(r, e, c, x - (0.2 if r == 2 and c == "b" else 0), y + (0.3 if r in (1, 2) else 0), m, False if (r, e) in ((2, 7), (2, 30)) else None) for r, e, c, x, y, m in base] + [(5, 0, "a", 1.0, 1.0, 1.0, None)]
    recorded = [(1, 60), (4, 59), (2, None)]
    made = gates.promotion(spark.createDataFrame(new, ROW + ", trap boolean"), spark.createDataFrame(base, ROW), spark.createDataFrame(recorded, "run long, entries long"), 100, 1)
    assert {r.run: (r.verdict, r.reasons) for r in made.collect()} == {
        1: ("merge", ["recall_5"]),
        2: ("hold", ["trap failures: 30, 7", "class regression: b recall_1"]),
        3: ("hold", ["no primary metric improved beyond its interval"]),
        4: ("hold", ["another number of entries"]),
        5: ("baseline", ["no baseline recorded"]),
    }


def test_promotion_without_pairs(spark):
    one, other = [(1, 1, "a", 1.0, 1.0, 1.0)], [(1, 2, "a", 1.0, 1.0, None)]
    made = gates.promotion(spark.createDataFrame([(*r, None) for r in one], ROW + ", trap boolean"), spark.createDataFrame(other, ROW), spark.createDataFrame([], "run long, entries long"), 50, 1)
    assert made.head().reasons == ["no paired values for recall_5", "no paired values for mrr", "no primary metric improved beyond its interval"]


def test_criteria_by_hand(spark):
    """Four answer cases of three repeats: passed 3, 2, 1 and 0 times; the last has no outcomes."""
    cases = [("s", k, "answer", "c", None, None) for k in range(4)] + [("t", 9, "abstain", "c", "p", "refusal")]
    seen = [("s", k, r, "scored", True, r > 3 - k, [], None, True, True, True, None, None, True) for k in range(3) for r in (1, 2, 3)]
    seen += [("t", 9, r, "scored", True, True, ["p"] if r == 3 else [], r != 2, None, None, None, True, False, None) for r in (1, 2, 3)]
    kinds = "`set` string, `case` long, `repeat` int, status string, completed boolean, refused boolean, critical_failures array<string>, critical_safe boolean, useful boolean, supported boolean, traceable boolean, appropriate_abstention boolean, fabricated boolean, evidence_supplied boolean"
    every = gates.cells(spark.createDataFrame(cases, "`set` string, `case` long, expected string, class string, probe string, probe_expects string"), spark.createDataFrame(seen, kinds), 3)
    rules = [("mean", "answer_pass", "answer", ">=", 0.5, "point", 1), ("major", "answer_pass", "answer", ">=", 0.5, "wilson_lower", 1), ("flips", "flip_rate", "all", "<=", 0.5, "point", 1), ("few", "completion_rate", "answer", ">=", 0.1, "point", 5), ("bad", "critical_failures", "all", "<=", 0.0, "point", 0)]
    found = gates.accepted(every, spark.createDataFrame(rules, verdicts._FIELDS), 3, 0.95, True)
    got = {(r.set, r.id): (r.n, r.value, r.status) for r in found.collect()}
    assert got["s", "mean"] == (4, 0.5, "pass") and got["s", "major"][:2] == (4, 0.5) and got["s", "major"][2] == "fail"
    assert got["s", "flips"] == (4, 0.5, "pass") and got["s", "few"] == (4, None, "insufficient") and got["s", "bad"] == (4, 0.0, "pass")
    assert got["t", "bad"] == (1, 2.0, "fail")  # one listed in repeat 3; one unlisted in repeat 2, which wasn't safe
    told = {r.set: (r.verdict, r.failing, r.lacking) for r in gates.acceptance(every, found, 3).collect()}
    assert told["s"] == ("rejected", "major", "few,outcomes_complete") and told["t"][0] == "rejected" and "critical_probes_assessed" in told["t"][1]


def test_interval_of_the_evaluation_equals_resamples_one_by_one(spark):
    from quernstone.plans.retrieval import _label_eval

    d = "/root/testdata/sf0.001"
    held = {}
    for r in _label_eval(spark, d, 8).collect():
        held.setdefault(r.label, []).append((r.query_id, r.mrr))
    for r in registry.queries()["ag27_bootstrap_ci"](spark, d).collect():
        means = drawn(held[r.label], resampling.RESAMPLES, 7)
        q = 0.025 * (len(means) - 1)
        assert r.lo == pytest.approx(means[int(q)] + q % 1 * (means[int(q) + 1] - means[int(q)]))
