"""Rules over labels, prices, job lines and hits, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .payloads import NATURAL_WORD_CHARS, NATURAL_WORD_MAX, collapsed

# The mark of a cut field, what a text is priced by, the shape of a roman numeral with the values of its
# letters and pairs, the head of a ranking in which nothing forbidden may stand.
ELLIPSIS = "…"
PRICED = r"[A-Za-z0-9]+|\n|[ \t]{2,}|[^\sA-Za-z0-9]"
ROMAN = r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})"
ROMAN_LETTERS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
ROMAN_PAIRS = {"iv": 2, "ix": 2, "xl": 20, "xc": 20, "cd": 200, "cm": 200}
MUST_NOT_WINDOW = 5


def clean_field(value: Column, limit: int) -> Column:
    """A stored field as one line of at most limit characters: control and separating characters read as blanks, those
    that only format vanish, blanks collapse, and an ellipsis says that something was cut."""
    text = F.regexp_replace(F.substring(value, 1, 8 * limit), r"[\p{Cf}\p{Cs}]", "")
    text = collapsed(F.regexp_replace(text, r"[\p{Cc}\p{Zl}\p{Zp}]", " "))
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit(ELLIPSIS))).otherwise(text)


def token_price(text: Column) -> Column:
    """Tokens that a text takes at most: ordinary words by twos of letters, other words by their characters, marks by
    their bytes; one blank before a word is free."""
    plain = f"^(?=.{{1,{NATURAL_WORD_MAX}}}$)[A-Za-z][a-z]*$"
    price = lambda run: (
        F.when(run.rlike(plain), F.ceil(F.length(run) / NATURAL_WORD_CHARS))
        .when(run.rlike("^[A-Za-z0-9]"), F.length(run).cast("long"))
        .when(run.rlike(r"^\s"), F.lit(1).cast("long"))
        .otherwise(F.octet_length(run).cast("long"))
    )
    runs = F.regexp_extract_all(text, F.lit(f"(?U){PRICED}".replace(r"[^\s", r"[^\s\x1c-\x1f")), F.lit(0))
    return F.aggregate(F.transform(runs, price), F.lit(0).cast("long"), lambda a, b: a + b)


def roman_value(token: Column) -> Column:
    """The value of a roman numeral of one case, else null: the letters' values, less twice what stands before a larger one."""
    low = F.lower(token)
    times = lambda marks: [F.regexp_count(low, F.lit(m)) * v for m, v in marks.items()]
    value = reduce(lambda a, b: a + b, times(ROMAN_LETTERS)) - reduce(lambda a, b: a + b, times(ROMAN_PAIRS))
    return F.when(token.rlike(r"^([a-z]+|[A-Z]+)\z") & low.rlike(rf"^{ROMAN}\z"), value)


def label_advances(before: Column, after: Column) -> Column:
    """Whether a printed label provably follows another: alike in shape, and growing at the first run that differs, be it
    a decimal or roman number or a single letter, each of one case. Digits and letters are those of ASCII."""
    runs = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+|[A-Za-z]+|[^0-9A-Za-z]+"), F.lit(0))
    a, b = runs(before), runs(after)
    first = F.get(F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"])), F.lit(0))
    x, y = first["x"], first["y"]
    both = lambda shape: x.rlike(shape) & y.rlike(shape)
    one_case = both("^[a-z]+$") | both("^[A-Z]+$")
    rx, ry = roman_value(x), roman_value(y)
    grows = (
        F.when(both("^[0-9]+$"), y.cast("decimal(38,0)") > x.cast("decimal(38,0)"))
        .when(one_case & rx.isNotNull() & ry.isNotNull(), ry > rx)
        .otherwise(one_case & (F.length(x) == 1) & (F.length(y) == 1) & (y > x))
    )
    return (F.size(a) == F.size(b)) & F.coalesce(grows, F.lit(False))


def must_not(rank: Column, doc: Column, messages: Column, barred_docs: Column, barred_messages: Column, asked: Column) -> Column:
    """(type, value) of what a hit in the head of a ranking holds against its query: a barred document, or barred messages
    unless one that the query asks for stands beside them."""
    met = F.array_sort(F.array_intersect(F.coalesce(messages, F.array().cast("array<string>")), barred_messages))
    beside = F.coalesce(F.arrays_overlap(messages, asked), F.lit(False))
    entry = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    found = F.array(
        F.when(F.array_contains(barred_docs, doc), entry("doc_id", doc)),
        F.when((F.size(met) > 0) & ~beside, entry("message_id", F.array_join(met, ","))),
    )
    return F.when(rank <= MUST_NOT_WINDOW, F.filter(found, lambda v: v.isNotNull())).otherwise(F.filter(found, lambda v: F.lit(False)))


def job_line(line: Column) -> Column:
    """name, job_id, owner, status, return_code and raw of a line of a job listing; a shorter line keeps raw alone, a blank one is null."""
    parts = F.filter(F.split(collapsed(line), " "), lambda p: p != "")
    whole = F.size(parts) >= 4
    code = F.get(F.reverse(F.filter(F.slice(parts, 5, F.greatest(F.size(parts), F.lit(1))), lambda p: F.upper(p).rlike("^(RC=|CC)"))), F.lit(0))
    fields = [F.when(whole, F.get(parts, F.lit(k))).alias(n) for k, n in enumerate(("name", "job_id", "owner", "status"))]
    return F.when(F.size(parts) > 0, F.struct(*fields, F.when(whole, F.regexp_replace(code, "^[^=]*=", "")).alias("return_code"), line.alias("raw")))


def gold_position(view: Column, gold: Column, cap: int) -> Column:
    """Where a gold string first stands, whatever its case: wholly within the kept head, not wholly, or nowhere."""
    at = F.instr(F.lower(view), F.lower(gold))
    return F.when(at == 0, "not_in_history").when(at - 1 + F.length(F.lower(gold)) <= cap, "before_cut").otherwise("after_cut")


def structure_gate(structural: Column, errors: Column, faithfulness: Column, relevance: Column) -> Column:
    """(verdict, reasons): failures of structure, of requests and of either judge hold; rates have no say."""
    counted = [(structural, "structural failure(s)"), (errors, "request error(s)"), (faithfulness, "faithfulness judge error(s)"), (relevance, "relevance judge error(s)")]
    reasons = F.array_compact(F.array(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}"))) for n, what in counted]))
    return F.struct(F.when(F.size(reasons) > 0, "hold").otherwise("pass").alias("verdict"), reasons.alias("reasons"))


def off_gold(indices: Column, expected: Column, hits: Column) -> Column:
    """Whether inferred citations all point (from 1) at hits of other documents than the expected ones; false where there is nothing to compare."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    on = F.exists(indices, lambda i: F.when(i >= 1, F.coalesce(F.array_contains(expected, F.get(hits, i - 1)), F.lit(False))).otherwise(False))
    known = F.forall(indices, lambda i: i.isNotNull())
    return F.coalesce(some(indices) & some(expected) & some(hits) & known & ~on, F.lit(False))
