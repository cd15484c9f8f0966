"""Listings derived from every document, and their statements.

A listing is made of a document's own lines: each gets the look of a card, a comment, a string, a clause, a code or plain prose, by
its place and the document's id. Splitting depends on nested comments and open strings, which SQL can't follow; tests hold the
queries against scanners that go character by character.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import listings as L
from ..sources.tables import table

JCL = ["concat('//S', k, ' EXEC PGM=', x, ',')", "concat('//   ', x)", "concat('// DD ', x)", "'  //  '", "concat('A=', x)", "concat('//D', k, ' DD *')", "x", "''", "concat(' //* ', x)", "'/*'"]
REXX = ["concat('/* rexx ', x)", "concat(x, ' */ say 1')", "concat('say \"', x, '\"; exit')", "concat('a = \\'', x, ';\\'\\'', x, '\\'')", "concat('call ', x, ',')", "''", "concat(x, ' /* /* ', x, ' */ ; */')", "concat('parse \\'', x)", "concat(x, '\\' ;; '' \" ; \"')", "concat('  ', x)"]
CODES = ["upper(hex(100 + pmod(hash(x), 900)))", "x", "'0C4'", "''", "'Explanation: it ended.'", "'U4038'", "concat('U', lpad(k, 4, '0'))", "x"]
CARDS = ["x", "concat('//S', k, ' EXEC PGM=A')", "concat('//     ', x)", "x", "''", "concat('//T', k, ' DD SYSOUT=A')", "x"]


def listing(spark, d, looks: list[str], step: int):
    """doc_id, heading, text: a document's lines, each of the look at (place * step + id)."""
    cases = " ".join(f"WHEN {k} THEN {look}" for k, look in enumerate(looks))
    made = f"array_join(transform(split(text, '\\n'), (x, i) -> CASE (i * {step} + i * i + doc_id) % {len(looks)} {cases} END), '\\n')".replace("k, ", "string(i), ").replace(", k)", ", string(i))")
    heading = F.when(F.col("doc_id") % 3 == 0, "Wait state codes").otherwise("Codes")
    return table(spark, d, "documents").select("doc_id", heading.alias("heading"), F.expr(made).alias("text"))


def _told(units):
    return [F.size("u").alias("units"), F.size(F.filter("u", lambda x: x["whole"])).alias("whole"), F.sha2(F.array_join(F.transform("u", lambda x: x["text"]), "\x1e"), 256).alias("sha256")]


def _split(looks, step, rule):
    def run(spark, d):
        return listing(spark, d, looks, step).select("doc_id", L.units_udf(rule)("text").alias("u")).select("doc_id", *_told("u"))

    return run


def regions(spark, d):
    parts = [listing(spark, d, looks, 1).select("doc_id", F.lit(n).alias("look"), L.region_of("text").alias("region")) for n, looks in (("jcl", JCL), ("rexx", REXX), ("codes", CODES))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def codes(spark, d):
    return listing(spark, d, CODES, 1).select("doc_id", L.codes_of("text", "heading").alias("c")).select("doc_id", F.array_join("c.codes", ",").alias("codes"), "c.labelled")


QUERIES = {
    "fn26_code_regions": regions,
    "fn27_jcl_statements": _split(JCL, 1, L.jcl_statements),
    "fn28_rexx_statements": _split(REXX, 3, L.rexx_statements),
    "fn29_mixed_items": _split(CARDS, 1, L.mixed_items),
    "fn30_code_entries": _split(CODES, 1, L.code_entries),
    "fn31_system_codes": codes,
}
