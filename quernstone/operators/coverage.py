"""A list of wished-for books against a catalog: by form number, else by words of their titles.

A title matches if all keywords of one group stand in it. That is a join over pairs, made equal by an inverted index: every group
is looked up by its rarest token in the titles only, and the few titles found are held against all its keywords.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A form number with its edition, hyphens gone; ids that may be shown.
FAMILY = r"^(REDP\d{4}|[A-Z]{2,4}\d{6})(?:\d{2})?$"
PUBLIC = r"^(?i:SG24|REDP)-?\d{4}(?:-?\d{2})?$"
#: What a title is looked up by: words, and any other sign by itself.
TOKEN = r"[0-9a-z]+|[^0-9a-z\s]"


def normalized(text: Column) -> Column:
    """Small letters, no apostrophes, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), "'’", "")), r"[\s\p{Z}]+", " "))


def family(doc_id: Column) -> Column:
    found = F.regexp_extract(F.upper(F.replace(doc_id, F.lit("-"), F.lit(""))), FAMILY, 1)
    return F.when(found != "", found).otherwise(doc_id)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def stands_in(keyword: Column, title: Column) -> Column:
    """Whether a normalized keyword stands in a title, with no letter or digit at its ends."""
    return F.regexp_like(title, F.concat(F.lit(r"(?<![0-9a-z])\Q"), keyword, F.lit(r"\E(?![0-9a-z])")))


def by_number(items: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, doc_id): items that list a document's family."""
    wanted = items.select("id", F.explode("numbers").alias("n")).select("id", F.replace("n", F.lit("-"), F.lit("")).alias("family"))
    return titles.select("doc_id", family(F.col("doc_id")).alias("family")).distinct().join(wanted.distinct(), "family").select("id", "doc_id").distinct()


def by_title(items: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, doc_id): documents of which one title holds all keywords of one of the item's groups, and whose id has one of its prefixes."""
    groups = items.select("id", F.posexplode("groups").alias("g", "words")).select("id", "g", F.transform("words", normalized).alias("words"))
    asked = groups.select("id", "g", F.explode(F.array_distinct(F.flatten(F.transform("words", tokens)))).alias("token"))
    known = titles.select("doc_id", normalized(F.col("title")).alias("title")).distinct()
    posts = known.select("doc_id", "title", F.explode(tokens(F.col("title"))).alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    often = posts.groupBy("token").agg(F.count("*").alias("df"))
    # a token that no title has rules its group out
    rarest = asked.join(often, "token", "left").groupBy("id", "g").agg(F.min_by("token", F.coalesce("df", F.lit(0))).alias("token"))
    met = posts.join(rarest, "token").join(groups, ["id", "g"]).where(F.forall("words", lambda w: stands_in(w, F.col("title"))))
    prefixes = items.select("id", "prefixes")
    starts = F.exists("prefixes", lambda p: F.startswith(F.upper("doc_id"), F.upper(p)))
    return met.join(prefixes, "id").where((F.coalesce(F.size("prefixes"), F.lit(0)) <= 0) | starts).select("id", "doc_id").distinct()


def covered(items: DataFrame, titles: DataFrame) -> DataFrame:
    """(id, status, matched_by, n, n_public): present by number, or by title where that is asked for and one family (or many
    expected ones) matches; ambiguous by another title; else missing. items: id, match (doc_number or title), numbers,
    groups, prefixes, expect_many. titles: doc_id, title (null: none)."""
    number, title = by_number(items, titles), by_title(items, titles)
    sum_up = lambda df, to: df.groupBy("id").agg(F.count("*").alias(f"{to}n"), F.count_if(F.col("doc_id").rlike(PUBLIC)).alias(f"{to}public"), F.count_distinct(family(F.col("doc_id"))).alias(f"{to}families"))
    told = items.select("id", "match", "expect_many").join(sum_up(number, "n_"), "id", "left").join(sum_up(title, "t_"), "id", "left")
    numbered, titled = F.col("n_n").isNotNull(), F.col("t_n").isNotNull()
    clear = (F.col("match") == "title") & ((F.col("t_families") == 1) | F.coalesce("expect_many", F.lit(False)))
    status = F.when(numbered | (titled & clear), "present").when(titled, "ambiguous").otherwise("missing")
    n, public = (F.when(numbered, F.col(f"n_{c}")).otherwise(F.coalesce(f"t_{c}", F.lit(0))) for c in ("n", "public"))
    # documents found by number are shown as they are listed
    return told.select("id", status.alias("status"), F.when(numbered, "doc_number").when(titled, "title").alias("matched_by"), n.alias("n"), F.when(numbered, n).otherwise(public).alias("n_public"))
