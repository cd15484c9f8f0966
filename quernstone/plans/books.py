"""Books of 20 documents each as pages, with outlines made of their own lines, in sections and chunks.

Every line whose place and document agree gives an entry with its first words, so titles stand on their pages; some recur, some are
front or back matter, and a fifth of the books has no outline. Folds over an outline and over paragraphs aren't SQL; tests hold
the functions against brute force, and the queries against the functions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sectioning
from ..sources.tables import table

_TITLES = "CASE pmod(hash(x.line), 19) WHEN 0 THEN 'Notices' WHEN 1 THEN 'Contents' WHEN 2 THEN 'Syntax' WHEN 3 THEN '' ELSE array_join(slice(split(x.line, ' '), 1, 3), ' ') END"


def records(spark, d):
    """(books, outline, pages)."""
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL")
    pages = docs.select(F.floor(F.col("doc_id") / 20).alias("book"), (F.col("doc_id") % 20).cast("int").alias("page"), "text")
    books = pages.select("book").distinct().withColumn("title", F.concat(F.lit("Book "), F.col("book").cast("string")))
    lines = pages.where("book % 5 > 0").select("book", "page", F.expr("posexplode(split(text, '\\n')) AS (at, line)"))
    some = lines.where("(at * 3 + page + book) % 7 < 2").select("book", "page", "at", F.struct("line").alias("x"))
    level = (F.col("at") + F.col("page")) % 3 + 1
    outline = some.select("book", (F.col("page") * 1000 + F.col("at")).alias("nth"), level.alias("level"), F.expr(_TITLES).alias("title"), (F.col("page") + 1).alias("page"))
    return books, outline, pages


def sections(spark, d):
    return sectioning.sectioned(*records(spark, d))


def chunks(spark, d):
    books, outline, pages = records(spark, d)
    made = sectioning.chunked(sectioning.sectioned(books, outline, pages), pages)
    return made.select(
        "book", "nth", "ordinal", "chunk_id", "page_start", "page_end", T.chunk_type(F.col("text")).alias("chunk_type"), F.array_join("codes", ",").alias("codes"),
        F.size(F.filter("units", lambda u: u["whole"])).alias("whole_units"), F.sha2("text", 256).alias("text_sha256"),
    )


QUERIES = {"fn36_outline_sections": sections, "fn34_section_chunks": chunks}
