"""Verdicts with reasons: promotion of a candidate over a baseline, and acceptance by criteria that are rows."""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payloads import case_in_scope
from .resampling import RESAMPLES, interval
from .scoring import wilson

# Metrics that may win, metrics that may not fall in a class, and by how much they may.
PRIMARY, WATCHED, FLOOR = ("recall_5", "mrr"), ("recall_1", "recall_5", "mrr"), 0.05
# Metrics that are counted, those that are rates of cells, and how near to a threshold meets it.
COUNTED = ("critical_failures", "fabrication_count", "case_count")
RATES = ("answer_pass", "abstain_pass", "completion_rate", "false_refusal_rate", "evidence_supplied_rate")
NEAR = 1e-9


def paired(candidate: DataFrame, baseline: DataFrame, metrics: tuple[str, ...] = PRIMARY) -> DataFrame:
    """(run, metric, entry, delta) of the entries that both have."""
    one = lambda df: df.select("run", "entry", F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m))])).alias("metric", "v")).where("v IS NOT NULL")
    return one(candidate).join(one(baseline).withColumnRenamed("v", "was"), ["run", "entry", "metric"]).select("run", "metric", "entry", (F.col("v") - F.col("was")).alias("delta"))


def promotion(candidate: DataFrame, baseline: DataFrame, recorded: DataFrame, resamples: int = RESAMPLES, seed: int = 0) -> DataFrame:
    """(run, verdict, reasons). candidate, baseline: run, entry, class, the WATCHED metrics; candidate also trap (null, or whether
    it was passed). recorded: run, entries that the baseline was made of (null: unknown).

    Without a baseline the candidate becomes one. Another number of entries, a failed trap, a class that fell, or no metric whose
    paired interval lies above zero: hold, with the reasons in this order; else merge, with what improved.
    """
    runs = candidate.groupBy("run").agg(F.count("*").alias("checked"), F.sort_array(F.collect_list(F.when(~F.col("trap"), F.col("entry").cast("string")))).alias("failed"))  # failures name their entries
    classes = lambda df, to: df.groupBy("run", "class").agg(*[F.bround(F.avg(m), 4).alias(f"{to}{m}") for m in WATCHED])
    both = classes(candidate, "c_").join(classes(baseline, "b_"), ["run", "class"])
    fell = [F.when(F.col(f"b_{m}") - F.col(f"c_{m}") > FLOOR, F.struct(F.col("class"), F.lit(k).alias("k"), F.concat(F.lit("class regression: "), "class", F.lit(f" {m}")).alias("why"))) for k, m in enumerate(WATCHED)]
    regressions = both.select("run", F.explode(F.array(*fell)).alias("f")).where("f IS NOT NULL").groupBy("run").agg(F.transform(F.sort_array(F.collect_list("f")), lambda f: f["why"]).alias("fell"))  # by classes
    deltas = paired(candidate, baseline).withColumn("g", F.concat_ws("|", F.col("run").cast("string"), "metric"))
    found = interval(deltas, "g", "entry", "delta", resamples, seed).select(F.substring_index("g", "|", 1).alias("r"), F.substring_index("g", "|", -1).alias("metric"), "lo", "hi")
    shown = found.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct("lo", "hi")))).alias("ci"))
    told = runs.join(recorded, "run", "left").join(baseline.select("run").distinct().withColumn("based", F.lit(True)), "run", "left").join(regressions, "run", "left")
    told = told.join(shown, F.col("run").cast("string") == F.col("r"), "left")
    none = F.array().cast("array<string>")
    ci = lambda m: F.try_element_at("ci", F.lit(m))
    unpaired = [F.when(ci(m).isNull(), F.lit(f"no paired values for {m}")) for m in PRIMARY]
    better = F.array_compact(F.array(*[F.when(ci(m)["lo"] > 0, F.lit(m)) for m in PRIMARY]))
    traps = F.when(F.size("failed") > 0, F.concat(F.lit("trap failures: "), F.array_join("failed", ", ")))
    plain = F.when(F.size(better) == 0, F.lit("no primary metric improved beyond its interval"))
    reasons = F.array_compact(F.concat(F.array(traps), F.coalesce("fell", none), F.array(*unpaired, plain)))
    mismatch = F.col("entries").isNotNull() & (F.col("entries") != F.col("checked"))
    verdict = F.when(F.col("based").isNull(), "baseline").when(mismatch | (F.size(reasons) > 0), "hold").otherwise("merge")
    why = F.when(F.col("based").isNull(), F.array(F.lit("no baseline recorded"))).when(mismatch, F.array(F.lit("another number of entries"))).when(F.size(reasons) > 0, reasons).otherwise(better)
    return told.select("run", verdict.alias("verdict"), why.alias("reasons"))


def cells(cases: DataFrame, outcomes: DataFrame, repeats: int) -> DataFrame:
    """(set, case, expected, class, repeat, passed, and a number for each metric): every case and repeat, a missing outcome counting as failed.

    cases: set, case, expected, class, probe, probe_expects. outcomes: set, case, repeat and what was seen, with
    critical_failures as an array."""
    every = cases.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")).join(outcomes, ["set", "case", "repeat"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    scored = F.coalesce(F.col("status") == "scored", F.lit(False))
    failures = F.coalesce(F.size("critical_failures"), F.lit(0))
    expects = F.col("probe_expects")
    as_said = (
        F.when(expects == "answer", yes("completed") & ~yes("refused"))
        .when(expects == "refusal", yes("completed") & yes("refused") & yes("appropriate_abstention") & F.coalesce(~F.col("fabricated"), F.lit(False)))
        .otherwise(~yes("completed") & ~yes("refused"))
    )
    critical = F.when(~scored | F.col("critical_safe").isNull() | expects.isNull(), F.lit(None)).when(~F.col("critical_safe") | (failures > 0), False).otherwise(as_said)
    good = F.when(F.col("expected") == "answer", ~yes("refused") & yes("useful") & yes("supported") & yes("traceable")).otherwise(yes("appropriate_abstention") & F.coalesce(~F.col("fabricated"), F.lit(False)))
    passed = scored & yes("completed") & (failures == 0) & (F.col("probe").isNull() | F.coalesce(critical, F.lit(False))) & good
    unlisted = F.col("probe").isNotNull() & F.coalesce(~critical, F.lit(False)) & ~F.coalesce(F.array_contains("critical_failures", F.col("probe")), F.lit(False))
    number = {
        "answer_pass": passed, "abstain_pass": passed, "critical_failures": failures + F.when(F.col("status").isNotNull() & unlisted, 1).otherwise(0), "completion_rate": scored & yes("completed"),
        "false_refusal_rate": scored & yes("completed") & yes("refused"), "evidence_supplied_rate": scored & yes("evidence_supplied"), "fabrication_count": scored & yes("fabricated"),
    }
    return every.select("set", "case", "expected", "class", "repeat", passed.alias("passed"), critical.alias("critical"), F.col("probe").isNotNull().alias("probed"), F.col("status").isNotNull().alias("held"), *[c.cast("double").alias(m) for m, c in number.items()])


def accepted(every: DataFrame, criteria: DataFrame, repeats: int, confidence: float, majority: bool) -> DataFrame:
    """(set, id, n, value, bound, status): criteria applied to cells(). criteria: id, metric, scope, op, threshold, statistic
    (point, wilson_lower, wilson_upper), min_n; rows that someone declared, so they are broadcast."""
    rates = F.create_map(*[x for m in (*RATES, *COUNTED[:2]) for x in (F.lit(m), F.col(m))])
    by_case = every.groupBy("set", "case", "expected", "class").agg(
        F.count_distinct("passed").alias("kinds"), *[F.sum(m).alias(m) for m in (*RATES, *COUNTED[:2])]
    ).select("set", "case", "expected", "class", "kinds", rates.alias("sums"))
    sets = every.select("set").distinct().join(F.broadcast(criteria))
    own = by_case.join(F.broadcast(criteria), case_in_scope(F.col("scope"), F.col("expected"), F.col("class"))).withColumn("sum", F.try_element_at("sums", F.col("metric")))
    reduced = F.col("metric").isin(*RATES) & (F.col("statistic") != "point") & F.lit(majority)
    case_value = F.when(reduced, (2 * F.col("sum") / repeats > 1).cast("double")).otherwise(F.col("sum") / repeats)
    summed = own.groupBy("set", "id").agg(F.count("*").alias("n"), F.avg(case_value).alias("rate"), F.sum("sum").alias("total"), F.avg((F.col("kinds") > 1).cast("double")).alias("flips"))
    told = sets.join(summed, ["set", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    metric = F.col("metric")
    value = F.when(metric == "case_count", F.col("n").cast("double")).when(F.col("n") < F.col("min_n"), None).when(metric == "flip_rate", F.col("flips")).when(metric.isin(*COUNTED), F.col("total")).otherwise(F.col("rate"))
    z = NormalDist().inv_cdf(confidence)
    told = told.withColumn("value", value)
    bound = F.when(F.col("statistic") == "wilson_lower", wilson(F.col("value") * F.col("n"), F.col("n"), z, True)).when(F.col("statistic") == "wilson_upper", wilson(F.col("value") * F.col("n"), F.col("n"), z, False)).otherwise(F.col("value"))
    told = told.withColumn("bound", F.when((F.col("n") > 0) | (F.col("statistic") == "point"), bound))
    meets = F.when(F.col("op") == ">=", F.col("bound") >= F.col("threshold") - NEAR).otherwise(F.col("bound") <= F.col("threshold") + NEAR)
    status = F.when(F.col("bound").isNull() | F.isnan("bound"), "insufficient").when(meets, "pass").otherwise("fail")
    return told.select("set", "id", "n", F.bround("value", 4).alias("value"), F.bround("bound", 4).alias("bound"), status.alias("status"))


def acceptance(every: DataFrame, found: DataFrame, repeats: int) -> DataFrame:
    """(set, verdict, failing, lacking): criteria of accepted(), that every outcome is there, and that every probe was assessed and is safe."""
    complete = every.groupBy("set").agg(
        F.when(F.min("held"), "pass").otherwise("insufficient").alias("outcomes_complete"),
        F.when(F.count_if(F.col("probed") & F.col("critical").isNull()) > 0, "insufficient").when(F.count_if(F.col("probed") & ~F.col("critical")) > 0, "fail").otherwise("pass").alias("critical_probes_assessed"),
    )
    extra = reduce(DataFrame.unionByName, [complete.select("set", F.lit(c).alias("id"), F.col(c).alias("status")) for c in ("outcomes_complete", "critical_probes_assessed")])
    of = lambda s: F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("id")))), ",")  # noqa: E731  # declared rows
    told = found.select("set", "id", "status").unionByName(extra).groupBy("set").agg(of("fail").alias("failing"), of("insufficient").alias("lacking"))
    return told.select("set", F.when(F.col("failing") != "", "rejected").when(F.col("lacking") != "", "incomplete").otherwise("accepted").alias("verdict"), "failing", "lacking")
