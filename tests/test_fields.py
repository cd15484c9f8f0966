"""Rules over labels, prices, job lines and hits against brute force, on literal rows."""

import itertools
import random
import re

from pyspark.sql import functions as F

from quernstone.functions import fields as X

from .test_payloads import column


def numeral(n):
    out = ""
    for value, mark in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += mark * (n // value)
        n %= value
    return out


ROMANS = {numeral(n): n for n in range(1, 4000)}


def value(token):
    return ROMANS.get(token.lower()) if token in (token.lower(), token.upper()) else None


def test_every_roman_numeral_and_no_other(spark):
    rng = random.Random(3)
    tokens = [*ROMANS, *map(str.upper, list(ROMANS)[::97]), *("".join(rng.choices("ivxlcdm", k=rng.randrange(1, 6))) for _ in range(300)), "", "Xi", "x1", "x\n", "abc"]
    assert column(spark, tokens, X.roman_value) == [value(t) for t in tokens]


def advances(a, b):
    runs = [re.findall("[0-9]+|[A-Za-z]+|[^0-9A-Za-z]+", x) for x in (a, b)]
    if len(runs[0]) != len(runs[1]):
        return False
    x, y = next(((p, q) for p, q in zip(*runs) if p != q), ("", ""))
    if x.isdecimal() and y.isdecimal():
        return int(x) < int(y)
    if not (x + y).isalpha() or (x + y) not in ((x + y).lower(), (x + y).upper()):
        return False
    if value(x) and value(y):
        return value(x) < value(y)
    return len(x) == len(y) == 1 and x < y


def test_labels_that_advance(spark):
    labels = ["1", "2", "10", "1-2", "1-10", "2-1", "A-9", "B-1", "b-1", "xii", "XII", "xiv", "xiv.2", "c", "d", "e", "z", "", "A-", "iiii", "02"]
    pairs = list(itertools.product(labels, repeat=2))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.y for r in df.select("i", X.label_advances(F.col("a"), F.col("b")).alias("y")).sort("i").collect()]
    assert got == [advances(*p) for p in pairs] and any(got)


def test_prices(spark):
    texts = {"": 0, "word": 2, "Word": 2, "WORD": 4, "wordy": 3, "w0rd": 4, "a" * 15: 8, "a" * 16: 16, "a b": 2, "a  b": 3, "a\n\nb": 4, "é": 2, "漢字": 6, "x-y_z": 5, "\t": 0, "\t\t": 1, "\u3000": 0, "\x1c": 0}
    assert column(spark, list(texts), X.token_price) == list(texts.values())


def test_fields_are_cut_with_a_mark(spark):
    texts = {"abcd": "abcd", "abcdef": "abcd…", "abc  def": "abc…", "a\u200bb\x00c": "ab c", "  a\n": "a", "": "", "x" * 60: "xxxx…"}
    assert column(spark, list(texts), lambda c: X.clean_field(c, 5)) == list(texts.values())
    assert column(spark, ["\u200b" * 40 + "tail"], lambda c: X.clean_field(c, 5)) == [""]


def test_job_lines(spark):
    lines = ["", "  ", "A J1 U", "A J1 U OUTPUT", "A J1 U OUTPUT x rc=8", "A  J1 U OUTPUT RC=0 CC1 4", "A J1 U S CC=a=b", "RC=1 RC=2 RC=3 RC=4"]
    want = [None, None, (None,) * 5 + (lines[2],), ("A", "J1", "U", "OUTPUT", None, lines[3]), ("A", "J1", "U", "OUTPUT", "8", lines[4]), ("A", "J1", "U", "OUTPUT", "CC1", lines[5]), ("A", "J1", "U", "S", "a=b", lines[6]), ("RC=1", "RC=2", "RC=3", "RC=4", None, lines[7])]
    assert [y and tuple(y) for y in column(spark, lines, X.job_line)] == want


def test_forbidden_hits(spark):
    rows = [(1, "D1", ["M1"], []), (5, "D2", ["M2", "M1"], []), (5, "D2", ["M1", "Q"], ["Q"]), (6, "D1", ["M1"], []), (2, "D3", None, ["Q"]), (3, "D3", ["Z"], [])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, rank int, doc string, m array<string>, q array<string>")
    rule = X.must_not(F.col("rank"), F.col("doc"), F.col("m"), F.array(F.lit("D1")), F.array(F.lit("M1"), F.lit("M2")), F.col("q"))
    got = [[tuple(v) for v in r.y] for r in df.select("i", rule.alias("y")).sort("i").collect()]
    assert got == [[("doc_id", "D1"), ("message_id", "M1")], [("message_id", "M1,M2")], [], [], [], []]


def test_gold_gates_and_indices(spark):
    views = ["abc GOLD", "abcdefg gold", "none", "gOlD"]
    assert column(spark, views, lambda c: X.gold_position(c, F.lit("Gold"), 8)) == ["before_cut", "after_cut", "not_in_history", "before_cut"]

    counts = list(itertools.product((0, 2), repeat=4))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(counts)], "i int, a int, b int, c int, d int")
    names = ("structural failure(s)", "request error(s)", "faithfulness judge error(s)", "relevance judge error(s)")
    got = [(r.y.verdict, r.y.reasons) for r in df.select("i", X.structure_gate(*map(F.col, "abcd")).alias("y")).sort("i").collect()]
    assert got == [("hold" if any(c) else "pass", [f"2 {n}" for n, x in zip(names, c) if x]) for c in counts]

    cases = [(None, ["a"], ["b"]), ([], ["a"], ["b"]), ([1], [], ["b"]), ([1], ["a"], None), ([1], ["a"], ["b"]), ([1, 2], ["a"], ["b", "a"]), ([0, 9, -1], ["a"], ["a"]), ([None], ["a"], ["b"])]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n array<int>, e array<string>, h array<string>")
    got = [r.y for r in df.select("i", X.off_gold(F.col("n"), F.col("e"), F.col("h")).alias("y")).sort("i").collect()]
    assert got == [False, False, False, False, True, False, True, False]
