"""Books to sections to chunks: outlines are read book by book, texts only page by page and section by section."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import listings, sections
from ..functions.text import LINE_END, SPACE



def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in fields.items()]))


_INT, _TEXT = T.IntegerType(), T.StringType()
SECTIONS = _rows(heading=_TEXT, start=_INT, end=_INT, first=_INT, until=_INT)
CHUNKS = _rows(chunk_id=_TEXT, page_start=_INT, page_end=_INT, text=_TEXT, units=_rows(begin=_INT, finish=_INT, whole=T.BooleanType()), codes=T.ArrayType(_TEXT))
#: Units kept with a chunk; of more, none are kept and they are found again when needed.
UNITS = 512


@F.pandas_udf(SECTIONS)
def _sections(title: pd.Series, pages: pd.Series, outline: pd.Series, shared: pd.Series, leads: pd.Series) -> pd.Series:
    def of(name, n, entries, texts, first_lines):
        if entries is not None and len(entries):
            found = sections.outlined(name or "", n, [sections.Entry(e["level"], e["title"] or "", e["page"]) for e in entries], {} if texts is None else {t["page"]: t["text"] or "" for t in texts})
        else:
            found = sections.windowed(name or "", [x["lead"] or "" for x in first_lines])
        return [s._asdict() for s in found]

    return pd.Series([of(*row) for row in zip(title, pages.tolist(), outline, shared, leads, strict=True)])


@F.pandas_udf(CHUNKS)
def _chunks(rev: pd.Series, heading: pd.Series, pages: pd.Series) -> pd.Series:
    def of(r, name, parts):
        texts = [(p["page"], p["text"] or "") for p in parts]
        coded = listings.is_code_section("\n".join(t for _, t in texts))
        out = []
        for n, b in enumerate(sections.section_blocks(texts)):
            units = [{"begin": a, "finish": z, "whole": w} for a, z, w in b.units] if any(w for *_, w in b.units) else []
            out.append({
                "chunk_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r}|{name}|{b.start}|{n}")), "page_start": b.start, "page_end": b.end, "text": b.text,
                "units": units if len(units) <= UNITS else None, "codes": listings.system_codes(b.text, name) if coded else [],
            })
        return out

    return pd.Series([of(*row) for row in zip(rev, heading, pages, strict=True)])


def sectioned(books: DataFrame, outline: DataFrame, pages: DataFrame) -> DataFrame:
    """book, nth (from 0), heading, start, end (pages from 0), first, until (characters of the first page).

    books: book, title. outline: book, nth, level, title, page (from 1). pages: book, page (gapless from 0), text. Of pages only
    those on which several entries begin are gathered by book, and first lines where a book has no outline.
    """
    entries = outline.groupBy("book").agg(F.sort_array(F.collect_list(F.struct("nth", "level", "title", "page"))).alias("outline"))
    starts = outline.groupBy("book", F.greatest(F.col("page") - 1, F.lit(0)).alias("page")).count().where("count > 1").select("book", "page")
    shared = pages.join(starts, ["book", "page"]).groupBy("book").agg(F.collect_list(F.struct("page", "text")).alias("shared"))
    lead = F.regexp_extract("text", f"^{SPACE}*([^{LINE_END[1:]}*)", 1)
    leads = pages.join(entries.select("book"), "book", "left_anti").groupBy("book").agg(F.sort_array(F.collect_list(F.struct("page", F.substring(lead, 1, 400).alias("lead")))).alias("leads"))
    counted = pages.groupBy("book").agg((F.max("page") + 1).cast("int").alias("pages"))
    told = books.join(counted, "book").join(entries, "book", "left").join(shared, "book", "left").join(leads, "book", "left")
    found = told.select("book", F.posexplode(_sections("title", "pages", "outline", "shared", "leads")).alias("nth", "s"))
    return found.select("book", "nth", "s.*")


def chunked(found: DataFrame, pages: DataFrame) -> DataFrame:
    """book, nth, heading, ordinal, chunk_id, page_start, page_end, text, units, codes of sectioned()'s sections. pages as there."""
    spread = found.where("end > start").select("*", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("page"))
    text = F.col("text")
    cut = F.when(F.col("until").isNull(), F.substring(text, F.col("first") + 1, F.length(text))).otherwise(F.substring(text, F.col("first") + 1, F.col("until") - F.col("first")))
    parts = spread.join(pages, ["book", "page"]).withColumn("text", F.when(F.col("page") == F.col("start"), cut).otherwise(text))
    held = parts.groupBy("book", "nth", "heading").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"))
    made = held.select("book", "nth", "heading", F.posexplode(_chunks(F.col("book").cast("string"), "heading", "pages")).alias("ordinal", "c"))
    return made.select("book", "nth", "heading", "ordinal", "c.*")
