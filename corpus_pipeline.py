"""From raw documents to packed sequences: language, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Other columns
are carried as they are, whatever their names. A null text has no language and goes in the first stage; the others leave it
as it is. A null id is compared with nothing. Texts are whole, however long. A document is an id with its text: different
texts of one id are different documents. An empty table stays one. Each stage sets what its Python workers need by itself
(reachable), as it may be called with any table of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import language_id, near_dedup, packing, pii, substring_dedup
from quernstone.llm.common import documents, unused, written
from quernstone.session import reachable

CAPACITY = 2048
#: Languages that stay; None for all that could be learned.
LANGUAGES: tuple[str, ...] | None = None


def _with_text(docs: DataFrame, new: DataFrame) -> DataFrame:
    """The columns of docs, with the texts of new and n_chars to match."""
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of LANGUAGES, or in any language where that is None; the language found is put down in lang
    where a document has none. Documents without text, or without a letter, have no language and go. Where nothing could
    be learned, only those go. Rows are judged each by itself, so those that repeat an id or a text fare alike."""
    reachable(spark)
    names = unused(docs.columns, "lang_pred", "score")
    prototypes = language_id.learn(docs, "lang", "doc_id", "text")
    if not prototypes:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language_id.predict(docs, prototypes, carry=tuple(c for c in docs.columns if c != "doc_id"), names_out=tuple(names))
    pred = F.col(names[0])
    kept = found.where(pred != language_id.UNKNOWN if LANGUAGES is None else pred.isin(list(LANGUAGES)))
    return kept.withColumn("lang", F.coalesce("lang", pred)).select(docs.columns)


def _nodes(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the name of the column that tells (doc_id, text) apart: doc_id itself where it doesn't repeat, else one in the same order."""
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").head(1):
        return docs, "doc_id"
    name = unused(docs.columns, "node")[0]
    place = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return docs.withColumn(name, F.concat(place, F.coalesce(F.sha2("text", 256), F.lit("")))), name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the least id (of one id's texts, the least by a
    digest). Of rows that repeat both id and text one stays, whichever it is. Null ids, and texts without words, all stay."""
    reachable(spark)
    nodes, node = _nodes(docs)
    gone = near_dedup.near_duplicates(nodes, node).where(~F.col("kept")).select(F.col("id").alias(node)).distinct()
    kept = nodes.join(gone, node, "left_anti")
    if node != "doc_id":
        again = written(nodes.groupBy(node).count().where(F.col(node).isNotNull() & (F.col("count") > 1)).select(node), "repeated")
        kept = kept.join(again, node, "left_anti").unionByName(kept.join(again, node, "left_semi").dropDuplicates([node]))
    return kept.select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts; documents without any keep theirs as it is."""
    reachable(spark)
    names = unused(docs.columns, "n_words", "n_removed", "kept", "kept_sha256")
    cut = substring_dedup.cut(docs, names=tuple(names))
    return _with_text(docs, cut.withColumn("text", F.coalesce(names[2], "text")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    reachable(spark)
    return _with_text(docs, pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of at most 2048 tokens."""
    import public_tokenizers

    reachable(spark)
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)
    return packing.pack(written(cut, "pieces"), CAPACITY)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: Sketches, spans and packing aren't SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
