"""Documents certified by markers, and a manifest that is declared pending before anything changes and committed after all is proved.

Control rows are appended, never changed: the latest of a kind counts. A generation is served only by a committed row that names
it, so whatever happens between begin and commit leaves the generation before it in place. What is stored is read once, into one
row a document and revision.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fields of a manifest whose change needs vectors made anew, and those that are only put down.
REEMBED = ("schema_version", "extraction_rules", "identity_schema", "embed_mode", "embed_model", "embed_model_revision", "dense_dim", "contextual_enabled", "context_llm_model", "context_prompt_version", "context_max_chars", "sparse_model", "sparse_weights_revision")
RECORD_ONLY = ("dense_query_prefix",)
CONTROL = "turn long, state string, digest string, generation string, manifest string"


def digest_of(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def outcome(stored: dict, wanted: dict) -> str:
    """compatible, record_only_drift or reembed_required, by the fields that differ."""
    changed = {k for k in stored.keys() | wanted.keys() if stored.get(k) != wanted.get(k)}
    return "compatible" if not changed else "record_only_drift" if changed <= set(RECORD_ONLY) else "reembed_required"


def compared(stored: Column, wanted: Column) -> Column:
    """(outcome, fields) of two manifests, as maps: fields that need vectors made anew come first and alone; a field that one lacks differs."""
    differing = lambda names: F.filter(F.array(*map(F.lit, names)), lambda k: ~F.try_element_at(stored, k).eqNullSafe(F.try_element_at(wanted, k)))
    anew, noted = differing(REEMBED), differing(RECORD_ONLY)
    told = lambda name, fields: F.struct(F.lit(name).alias("outcome"), fields.alias("fields"))
    return F.when(F.size(anew) > 0, told("reembed_required", anew)).when(F.size(noted) > 0, told("record_only_drift", noted)).otherwise(told("compatible", anew))


def snapshot(points: DataFrame) -> DataFrame:
    """(doc_id, source_rev, n, shas, rules, ids_digest, content_digest) of stored points (doc_id, source_rev, chunk_id, sha256,
    rules_v, text). Digests go over a document's chunks in the order of their ids; a document's digests, not its texts, are gathered."""
    one = points.select("doc_id", "source_rev", "sha256", "rules_v", F.struct("chunk_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("t")).alias("c"))
    told = one.groupBy("doc_id", "source_rev").agg(F.count("*").alias("n"), F.collect_set("sha256").alias("shas"), F.collect_set("rules_v").alias("rules"), F.sort_array(F.collect_list("c")).alias("cs"))
    over = lambda f: F.sha2(F.array_join(F.transform("cs", f), "\n"), 256)
    return told.select("doc_id", "source_rev", "n", "shas", "rules", over(lambda c: c["chunk_id"]).alias("ids_digest"), over(lambda c: F.concat(c["chunk_id"], F.lit(" "), c["t"])).alias("content_digest"))


def latest(markers: DataFrame) -> DataFrame:
    """The last marker (by turn) of each document, revision and generation; one that was withdrawn counts as none."""
    order = Window.partitionBy("doc_id", "source_rev", "generation").orderBy(F.desc("turn"))
    return markers.withColumn("nth", F.row_number().over(order)).where("nth = 1 AND NOT withdrawn").drop("nth")


def verified(walked: DataFrame, markers: DataFrame, stored: DataFrame, generation: str, digest: str) -> DataFrame:
    """(doc_id, source_rev, problem): null where a walked document (doc_id, source_rev, sha256, rules_v) is complete. The first that fails:
    unmarked, another manifest, another content or other rules than marked, no points, their number, what they say they are made
    of, their ids, their texts."""
    own = latest(markers).where(F.col("generation") == generation).select("doc_id", "source_rev", "manifest_digest", F.col("sha256").alias("m_sha"), F.col("rules_v").alias("m_rules"), "expected", F.col("ids_digest").alias("m_ids"), F.col("content_digest").alias("m_content"))
    told = walked.join(own, ["doc_id", "source_rev"], "left").join(stored, ["doc_id", "source_rev"], "left")
    is_ = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    only = lambda a, b: F.coalesce((F.size(a) == 1) & (F.get(a, F.lit(0)) == F.col(b)), F.lit(False))
    problem = (
        F.when(F.col("expected").isNull(), "unmarked").when(F.coalesce(F.col("manifest_digest") != digest, F.lit(True)), "manifest")
        .when(~is_("m_sha", "sha256") | ~is_("m_rules", "rules_v") | (F.col("expected") < 1), "marker").when(F.col("n").isNull(), "no points")
        .when(~is_("n", "expected"), "count").when(~only("shas", "sha256") | ~only("rules", "rules_v"), "source").when(~is_("ids_digest", "m_ids"), "ids").when(~is_("content_digest", "m_content"), "content")
    )
    return told.select("doc_id", "source_rev", problem.alias("problem"))


def blockers(found: DataFrame, markers: DataFrame, stored: DataFrame, generation: str, digest: str, retired: DataFrame) -> DataFrame:
    """(doc_id, source_rev, problem) of all that keeps a generation from being published: walked documents that aren't complete,
    points that nobody walked, and markers under another manifest; revisions in retired (doc_id, source_rev) apart."""
    unwalked = stored.join(found, ["doc_id", "source_rev"], "left_anti").select("doc_id", "source_rev", F.lit("residue").alias("problem"))
    stale = latest(markers).where((F.col("generation") == generation) & (F.col("manifest_digest") != digest)).select("doc_id", "source_rev", F.lit("stale marker").alias("problem"))
    every = found.where("problem IS NOT NULL").unionByName(unwalked).unionByName(stale)
    return every.join(retired, ["doc_id", "source_rev"], "left_anti").distinct()


class Manifest:
    """Control rows of a collection below root, and the generation that they let be served."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(CONTROL).json(f"{self.root}/control")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], CONTROL)
            raise

    def _last(self, committed: bool = False):
        rows = self._rows().where("state = 'committed'") if committed else self._rows()
        return rows.orderBy(F.desc("turn")).first()

    def _append(self, state: str, manifest: dict, generation: str | None) -> None:
        last = self._last()
        row = ((last["turn"] if last else 0) + 1, state, digest_of(manifest), generation, json.dumps(manifest, sort_keys=True))
        self.spark.createDataFrame([row], CONTROL).coalesce(1).write.mode("append").json(f"{self.root}/control")

    def serving(self) -> str | None:
        """The generation of the last committed row."""
        last = self._last(committed=True)
        return last["generation"] if last else None

    def begin(self, manifest: dict) -> str:
        """already_current, committed (what changed needs nothing anew), or pending: declared before anything is deleted or written."""
        last = self._last()
        if last and last["state"] == "committed":
            found = outcome(json.loads(last["manifest"]), manifest)
            if found == "compatible":
                return "already_current"
            if found == "record_only_drift":
                self._append("committed", manifest, last["generation"])
                return "committed"
        self._append("pending", manifest, None)
        return "pending"

    def commit(self, manifest: dict, generation: str, problems: DataFrame) -> None:
        """Lets a generation be served. Refused unless this manifest was begun last and nothing is in its way."""
        last = self._last()
        if last is None or last["state"] != "pending" or last["digest"] != digest_of(manifest):
            raise RuntimeError("this manifest isn't pending")
        if found := problems.head(1):
            raise RuntimeError(f"not complete: {found[0]['problem']}")
        self._append("committed", manifest, generation)
