"""Immutable generations of a table behind a pointer: write beside, verify, then swap."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(rows: DataFrame, key: str) -> tuple[int, str]:
    """Row count and an order-free digest of all columns; sums of row hashes, so nothing is gathered."""
    hashed = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    low, high = F.sum(F.pmod(hashed, F.lit(1 << 31))), F.bit_xor(hashed)
    n, a, b = rows.agg(F.count(F.lit(1)), low, high).first()
    return n, f"{a or 0:x}-{(b or 0) & (2**64 - 1):016x}"


class Generations:
    """A table at root: generations in folders of their own, and a pointer that names the one to serve."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _pointer(self) -> DataFrame | None:
        try:
            return self.spark.read.json(f"{self.root}/pointer")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def current(self) -> DataFrame | None:
        pointer = self._pointer()
        name = pointer.orderBy(F.desc("turn")).first()["generation"] if pointer is not None else None
        return self.spark.read.parquet(f"{self.root}/{name}") if name else None

    def publish(self, rows: DataFrame) -> str:
        """Writes a generation, reads it back against its digest, and points to it."""
        name = f"g-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        if digest(self.spark.read.parquet(f"{self.root}/{name}"), self.key) != digest(rows, self.key):
            raise RuntimeError("the generation doesn't read back as written")
        pointer = self._pointer()
        turn = 1 + (pointer.agg(F.max("turn")).first()[0] if pointer is not None else 0)
        self.spark.createDataFrame([(turn, name)], "turn long, generation string").write.mode("append").json(f"{self.root}/pointer")
        return name

    def upsert(self, rows: DataFrame) -> str:
        """Rows replace those of equal key; the old generation stays readable."""
        held = self.current()
        return self.publish(rows if held is None else held.join(rows.select(self.key), self.key, "left_anti").unionByName(rows))

    def delete(self, condition) -> str:
        """A generation without the rows that the condition holds for."""
        held = self.current()
        if held is None:
            raise LookupError("nothing is published")
        return self.publish(held.where(~F.coalesce(condition, F.lit(False))))
