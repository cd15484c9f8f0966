"""One query text for two engines: the few functions that Spark and DuckDB spell differently."""

from __future__ import annotations

import re
from collections.abc import Callable

from ..sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    name = "spark"
    string, double, bigint = "STRING", "DOUBLE", "BIGINT"

    def lit(self, x: str) -> str:
        return "r'" + x.replace("'", "\\'") + "'" if "\\" not in x.replace("\\'", "") or "'" not in x else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, '{by}')"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.lit(pattern)})"

    def extract(self, x: str, pattern: str, group: int) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def size(self, x: str) -> str:
        return f"size({x})"

    def filter(self, x: str, v: str, cond: str) -> str:
        return f"filter({x}, {v} -> {cond})"

    def map(self, x: str, v: str, e: str) -> str:
        return f"transform({x}, {v} -> {e})"

    def join(self, x: str, sep: str) -> str:
        return f"array_join({x}, '{sep}')"

    def sorted_distinct(self, x: str) -> str:
        return f"array_sort(array_distinct({x}))"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit(re.escape(sep) if sep != chr(10) else chr(92) + 'n')})"

    def at(self, x: str, i: int) -> str:
        return f"try_element_at({x}, {i})"

    def has(self, x: str, y: str) -> str:
        return f"array_contains({x}, {y})"

    def both(self, x: str, y: str) -> str:
        return f"array_intersect({x}, {y})"

    def listed(self, x: str, order: str, where: str = "true") -> str:
        """x of a group's rows in an order that ends in a unique key."""
        return f"transform(array_sort(collect_list(struct({order}, {x} AS _v)) FILTER (WHERE {where})), _s -> _s._v)"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def disc(self, x: str, p: float) -> str:
        return f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})"

    def cont(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def explode(self, x: str, alias: str) -> str:
        return f"explode({x}) AS {alias}"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, '$.{path}')"

    def bytes(self, x: str) -> str:
        return f"octet_length({x})"

    def day(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM-dd')"

    def epoch(self, x: str) -> str:
        return f"unix_seconds(CAST({x} AS TIMESTAMP))"

    def range(self, a: str, b: str) -> str:
        return f"sequence({a}, {b})"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def even(self, x: str, n: int) -> str:
        return f"bround({x}, {n})"

    def lines(self, source: str, keep: str) -> str:
        """Rows (keep, i, line) of the lines of a text column."""
        return f"SELECT {keep}, i, line FROM {source} LATERAL VIEW posexplode(split(text, '\\\\n')) AS i, line"

    def text_of(self, x: str) -> str:
        return f"CAST({x} AS STRING)"

    def instr(self, x: str, y: str) -> str:
        return f"instr({x}, {y})"

    def interval(self, x: str, seconds: int) -> str:
        return f"{x} + INTERVAL {seconds} SECONDS"


class Duck(Spark):
    name = "duck"

    def lit(self, x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, '{re.sub(r'[$]([0-9])', chr(92) * 2 + '1', by).replace(chr(92) * 2, chr(92))}', 'g')"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def size(self, x: str) -> str:
        return f"len({x})"

    def filter(self, x: str, v: str, cond: str) -> str:
        return f"list_filter({x}, lambda {v}: {cond})"

    def map(self, x: str, v: str, e: str) -> str:
        return f"list_transform({x}, lambda {v}: {e})"

    def join(self, x: str, sep: str) -> str:
        return f"array_to_string({x}, '{sep}')"

    def sorted_distinct(self, x: str) -> str:
        return f"list_sort(list_distinct({x}))"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.lit(sep) if sep != chr(10) else 'chr(10)'})"

    def at(self, x: str, i: int) -> str:
        return f"({x})[{i}]"

    def has(self, x: str, y: str) -> str:
        return f"list_contains({x}, {y})"

    def both(self, x: str, y: str) -> str:
        return f"list_intersect({x}, {y})"

    def listed(self, x: str, order: str, where: str = "true") -> str:
        return f"coalesce(list({x} ORDER BY {order}) FILTER (WHERE {where}), [])"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def cont(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def explode(self, x: str, alias: str) -> str:
        return f"unnest({x}) AS {alias}"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, '$.{path}')"

    def bytes(self, x: str) -> str:
        return f"strlen({x})"

    def day(self, x: str) -> str:
        return f"strftime({x}, '%Y-%m-%d')"

    def epoch(self, x: str) -> str:
        return f"CAST(floor(epoch({x})) AS BIGINT)"

    def range(self, a: str, b: str) -> str:
        return f"range({a}, {b} + 1)"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def even(self, x: str, n: int) -> str:
        return f"round_even({x}, {n})"

    def lines(self, source: str, keep: str) -> str:
        return f"SELECT {keep}, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM {source})"


def query(text: Callable[[Spark], str]) -> Callable:
    """A registered query from a text in Spark's dialect, over views of the tables that it names."""
    sql = text(Spark())

    def run(spark, d):
        for name in TABLES:
            if re.search(rf"\b{name}\b", sql):
                table(spark, d, name).createOrReplaceTempView(name)
        return spark.sql(sql)

    run.__doc__ = text.__doc__
    run.__name__ = text.__name__
    return run


def registered(texts: dict[str, Callable[[Spark], str]]) -> tuple[dict, dict]:
    return {k: query(t) for k, t in texts.items()}, {k: t(Duck()) for k, t in texts.items()}
