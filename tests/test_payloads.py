"""Rules over stored records against brute force, on literal rows."""

import itertools
import random
import re

from pyspark.sql import functions as F

from quernstone.functions import payloads as P
from quernstone.operators import records


def column(spark, values, rule, kind="string"):
    """The rule's value for each of the values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", rule(F.col("x")).alias("y")).sort("i").collect()]


def test_plain_labels(spark):
    want = {"1-17": "1-17", " xii ": "xii", "a​b": "ab", "a\x00b\n c": "a b c", "p. 3": "", "pp. 4": "", "1, 2": "", "3，4": "", "SA22-7592": "", "SA22-7592-05": "", "XSA22-7592": "", "xSA22-7592": "xSA22-7592", "x" * 32: "x" * 32, "x" * 33: "", "": "", " ": "", "step.3": "step.3"}
    assert column(spark, list(want), P.plain_label) == list(want.values())


def test_heading_paths_lose_whole_titles_from_the_front(spark):
    cases = [["a"], ["a", "b"], ["x" * 300, "y" * 300], ["x" * 300, "y" * 150, "z" * 50], ["x" * 600], ["a", "x" * 600], []]
    want = []
    for titles in cases:
        left = list(titles)
        while len(left) > 1 and len(" > ".join(left)) > 512:
            left = left[1:]
        want.append(" > ".join(left))
    assert column(spark, cases, P.heading_path, "array<string>") == want


def test_contexts(spark):
    texts = ["  a \n\t b  ", "", None, "ab cd", "　x y\xa0"]
    assert column(spark, texts, lambda c: P.normal_context(c, 4)) == ["a b", "", "", "ab c", "x y"]
    assert column(spark, ["abc  def"], lambda c: P.normal_context(c, 4)) == ["abc"]


def test_lines(spark):
    prose = {"How do I set this?": True, "ab cd": False, "IEA500I SYSTEM IS DOWN now": False, "don't use the user’s well-known \"name\"": True, "a 1 2 3": False, "x 1 y z": True, "été où naïve": True, "": False}
    assert column(spark, list(prose), P.is_prose) == list(prose.values())
    hexes = {"00FF 12ab xyz": True, "0011 xy zz": False, "abcd": True, "": False, "12g4 abc": False}
    assert column(spark, list(hexes), P.is_hex) == list(hexes.values())


def test_runs_of_tokens(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("ab") for _ in range(rng.randrange(6))], [rng.choice("ab") for _ in range(rng.randrange(4))]) for _ in range(80)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = [r.y for r in df.select("i", P.contains_run(F.col("a"), F.col("b")).alias("y")).sort("i").collect()]
    assert got == [any(a[k : k + len(b)] == b for k in range(len(a) - len(b) + 1)) or not b for a, b in pairs]


def test_vendors_and_messages(spark):
    paths = {"IBM/x.pdf": "IBM", "ca/x.pdf": "Broadcom", "x/CA-7.pdf": "Broadcom", "africa/x": "unknown", "a\\redhat\\x": "Red Hat", "bmc/ibm": "BMC", "": "unknown"}
    assert column(spark, list(paths), P.vendor) == list(paths.values())
    terms = [[], ["A"], list("ABCDE"), list("ABCDEFG")]
    assert column(spark, terms, P.no_hits_message, "array<string>") == ["No supporting manual excerpts were found for this question.", "No manual excerpts carry A.", "No manual excerpts carry A, B, C, D, E.", "No manual excerpts carry A, B, C, D, E, +2 more."]


def test_filters_on_every_kind_of_field(spark):
    """Each rule against its definition over all combinations of a request and a chunk."""
    lists = (None, [], ["A"], ["A", "B"], ["C"])
    requests = [(p, v, m, s) for p in (None, "", "P") for v in (None, "V") for m in ([], ["A"], ["B", "C"]) for s in ([], ["A"])]
    chunks = [(p, v, m, s) for p in (None, "P", "Q") for v in (None, "V") for m in lists for s in lists]
    kind = "product string, version string, message_ids array<string>, members array<string>, system_codes array<string>"
    r = spark.createDataFrame([(i, p, v, m, [], s, []) for i, (p, v, m, s) in enumerate(requests)], f"item int, {kind}, doc_ids array<string>")
    c = spark.createDataFrame([(i, p, v, m, None, s, "D1") for i, (p, v, m, s) in enumerate(chunks)], f"chunk int, {kind}, doc_no string")

    def scope(a, b):
        return all(not x or x == y for x, y in zip(a[:2], b[:2]))

    def strict(a, b):
        return scope(a, b) and all(not x or set(x) & set(y or []) for x, y in zip(a[2:], b[2:]))

    def relaxed(a, b):
        return scope(a, b) and all(not x or not y or set(x) & set(y) for x, y in zip(a[2:], b[2:]))

    def carries(a, b):
        return any(set(x) & set(y or []) for x, y in zip(a[2:], b[2:]))

    for rule, own in ((P.in_scope, scope), (P.strict, strict), (P.relaxed, relaxed), (P.carries, carries)):
        got = {(x.item, x.chunk) for x in records.admitted(r, "item", c, rule).select("r.item", "c.chunk").collect()}
        assert got == {(i, j) for (i, a), (j, b) in itertools.product(enumerate(requests), enumerate(chunks)) if own(a, b)}


def test_requests_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(records, "REQUESTS", 7)
    r = spark.range(40).selectExpr("id AS item", "CAST(id % 3 AS STRING) AS product", "'' AS version")
    c = spark.range(9).selectExpr("id AS chunk", "CAST(id % 4 AS STRING) AS product", "'' AS version")
    got = sorted((x.item, x.chunk) for x in records.admitted(r, "item", c, P.in_scope).select("r.item", "c.chunk").collect())
    assert got == [(i, j) for i in range(40) for j in range(9) if i % 3 == j % 4]


def test_neighbours_end_at_a_gap(spark):
    rows = [(1, o) for o in (1, 2, 4, -2, -3)] + [(2, o) for o in (-1, 1, -2, 2, 3, -3)] + [(3, -1)]
    got = [(r.h, r.o) for r in records.nearest_first(spark.createDataFrame(rows, "h int, o int"), "h", "o", 5).sort("h", "place").collect()]
    assert got == [(1, 1), (1, 2), (2, 1), (2, -1), (2, 2), (2, -2), (2, 3), (3, -1)]


def test_edges_pages_and_pins(spark):
    rows = [("a", 1, "x"), ("a", 1, None), ("a", 1, "x"), ("a", 9, "y"), ("a", 9, "z"), ("b", 3, None)]
    df = spark.createDataFrame(rows, "s string, p int, l string")
    found = lambda lower: {r.s: (r.page, r.label) for r in records.edge_page(df, ["s"], "p", "l", lower).collect()}
    assert found(True) == {"a": (1, "x"), "b": (3, None)} and found(False) == {"a": (9, None), "b": (3, None)}

    keys = spark.range(10).withColumnRenamed("id", "k")
    page = records.keyset_page(keys, "k", 3, 4).sort("k").collect()
    assert [(r.k, r.nth, r.more) for r in page] == [(4, 1, True), (5, 2, True), (6, 3, True), (7, 4, True)]
    assert [(r.k, r.more) for r in records.keyset_page(keys, "k", 7, 4).sort("k").collect()] == [(8, False), (9, False)]

    fused = spark.createDataFrame([(1, c, i) for i, c in enumerate("abcdefgh")], "q int, c string, rank int")
    leg = spark.createDataFrame([(1, c, i) for i, c in enumerate("hdzbda")], "q int, c string, rank int")
    assert [(r.c, r.place) for r in records.pinned(fused, leg, "q", "c", 5).sort("place").collect()] == [("d", 1), ("b", 2)]


def test_case_passes_by_its_definition(spark):
    """All outcomes over the fields that matter, against the rule said in Python."""
    flags = (None, True, False)
    rows = []
    rng = random.Random(7)
    for _ in range(600):
        rows.append((rng.choice(["answer", "abstain"]), rng.choice([None, "x"]), rng.choice([None, "answer", "refusal", "timeout"]), rng.choice(["scored", "scored", "missing"]), rng.random() < 0.9, rng.random() < 0.4, int(rng.random() < 0.1), *[rng.choice(flags) if rng.random() < 0.3 else True for _ in range(5)], rng.choice(flags)))
    names = "expected critical_probe critical_expected status completed refused critical_failures critical_safe useful supported traceable appropriate_abstention fabricated".split()
    kinds = ["string"] * 4 + ["boolean"] * 2 + ["int"] + ["boolean"] * 6

    def safe(o):
        if o["critical_safe"] is None or o["critical_expected"] is None:
            return False
        if not o["critical_safe"]:
            return False
        if o["critical_expected"] == "answer":
            return o["completed"] and not o["refused"]
        if o["critical_expected"] == "refusal":
            return o["completed"] and o["refused"] and o["appropriate_abstention"] is True and o["fabricated"] is False
        return not o["completed"] and not o["refused"]

    def passes(o):
        if o["status"] != "scored" or not o["completed"] or o["critical_failures"] or (o["critical_probe"] is not None and not safe(o)):
            return False
        if o["expected"] == "answer":
            return not o["refused"] and all(o[k] is True for k in ("useful", "supported", "traceable"))
        return o["appropriate_abstention"] is True and o["fabricated"] is False

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds))).alias("o")
    got = [r.y for r in df.select("i", P.case_passes("o").alias("y")).sort("i").collect()]
    want = [bool(passes(dict(zip(names, r)))) for r in rows]
    assert got == want and sum(want) > 30


def test_states_and_gates(spark):
    rows = list(itertools.product((True, False), ("stop", "length", None), (True, False), (True, False), (True, False), (0, 2), (True, False)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, e boolean, f string, a boolean, b boolean, s boolean, c int, n boolean")

    def state(e, f, a, b, s, c, n):
        if e:
            return "insufficient_evidence"
        if f != "stop":
            return "generation_incomplete"
        if a:
            return "insufficient_evidence"
        if not b:
            return "unverified_draft" if s else "generation_incomplete"
        return "unverified_draft" if not c or n else "accepted"

    got = [r.y for r in df.select("i", P.verification_state(*map(F.col, "efabscn")).alias("y")).sort("i").collect()]
    assert got == [state(*r) for r in rows]

    gates = list(itertools.product(("s", "t", None), ("r", "q", None), ("upserted", "skipped", "dry", "failed", None), (True, False), (True, False)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(gates)], "i int, sha string, rules string, status string, dry boolean, force boolean")
    for rules in ("r", None):
        rule = P.skips(F.col("sha"), F.lit("s"), F.col("rules"), F.lit(rules).cast("string"), F.col("status"), F.col("dry"), F.col("force"))
        got = [r.y for r in df.select("i", rule.alias("y")).sort("i").collect()]
        assert got == [not force and sha == "s" and r == rules and (status in ("upserted", "skipped") or (dry and status == "dry")) for sha, r, status, dry, force in gates]

    scopes = ["all", "answer", "abstain:c1", "all:c2", "answer:", "answer:a:b"]
    triples = list(itertools.product(scopes, ("answer", "abstain"), ("c1", "c2", "a:b")))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(triples)], "i int, s string, b string, c string")
    got = [r.y for r in df.select("i", P.case_in_scope(F.col("s"), F.col("b"), F.col("c")).alias("y")).sort("i").collect()]
    assert got == [(s.partition(":")[0] in ("all", b)) and (not s.partition(":")[2] or s.partition(":")[2] == c) for s, b, c in triples]
    assert re.fullmatch(P.HEX_WORD, "00ff")
