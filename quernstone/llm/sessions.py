"""Sessions of clicks by gaps, final clicks and a longest span.

Triage. SQL windows over (client, block of time) mark the hard breaks (after a final click, or after a gap); one row a client
and block then tells which islands between hard breaks go on over a block's edge. Islands that span no more than `longest`
are sessions as they are. Only the clicks of longer islands go to Arrow, in groups of one island and block: as the greedy
cut depends on what came before, a first pass notes for every click that could be the first new session of its block where
that would lead in the next block, the notes are composed by doubling joins, and a second pass cuts each block from where
it is really entered. Sessions of both kinds are joined up and summarised in SQL.

No step gathers a client: windows over a client see one row a block, groups hold one block of one client, and a list is made
of a session's clicks only, which span `longest` at most.

Defined results: of rows that repeat a click's id the one that arrived first counts (then the least in the other columns read);
a null id is one click, with the least id, whose session has no id and which its path leaves out; clicks without client or time
are dropped; a null arrival is in time; a null amount is 0; ties in time follow the click's id; an empty table gives an empty
result; only the named columns are read, so other columns' names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reachable
from .common import written

MINUTE = 60_000_000
#: Stands for a null click id inside.
NO_ID = -(1 << 63)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time with or without a zone."""
    if df.schema[name].dataType.simpleString() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(f"`{name}`"))


def _once(clicks: DataFrame, client: str, click: str, at: str, arrived: str, final: Column, amount: Column) -> DataFrame:
    """client, click, us, wait (arrival after us), final, cents: one row a click."""
    rows = clicks.select(
        F.col(f"`{click}`").cast("long").alias("click"),
        F.struct(micros(clicks, arrived).alias("came"), micros(clicks, at).alias("us"), F.col(f"`{client}`").alias("client"),
                 F.coalesce(final, F.lit(False)).alias("final"), F.coalesce(amount.cast("long"), F.lit(0)).alias("cents")).alias("r"),
    )
    one = rows.where("r.client IS NOT NULL AND r.us IS NOT NULL").groupBy("click").agg(F.min("r").alias("r"))
    return one.select(F.coalesce("click", F.lit(NO_ID)).alias("click"), "r.client", "r.us", (F.col("r.came") - F.col("r.us")).alias("wait"), "r.final", "r.cents")


def _block(us: Column, block: int) -> Column:
    return F.floor(us / F.lit(block)).cast("long")


def _pieces(once: DataFrame, gap: int) -> DataFrame:
    """The pieces between hard breaks within each block: client, block, late, piece (from 0), path (us, click, cents in
    order), cents, final (of the last click). Late clicks, told apart by `late`, have pieces of their own."""
    inside = Window.partitionBy("client", "block", "late").orderBy("us", "click")
    before = F.lag(F.struct("us", "final")).over(inside)
    hard = F.coalesce(before["final"] | (F.col("us") - before["us"] >= gap), F.lit(False))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    numbered = once.select("*", hard.cast("int").alias("hard")).select("*", F.sum("hard").over(so_far).alias("piece"))
    made = numbered.groupBy("client", "block", "late", "piece").agg(F.sort_array(F.collect_list(F.struct("us", "click", "cents"))).alias("path"), F.sum("cents").alias("cents"), F.max("final").alias("final"))
    return made.select("*", F.struct(F.col("path")[0]["us"].alias("us"), F.col("path")[0]["click"].alias("click")).alias("head"), F.element_at("path", -1)["us"].alias("tail"))


def _edges(pieces: DataFrame, gap: int) -> DataFrame:
    """One row a client and block: where the island of its first piece began and ends, where that of its last piece ends,
    whether it was entered from the block before and runs on into the next, whether the client clicks later."""
    blocks = pieces.groupBy("client", "block").agg(
        F.max("piece").alias("last_piece"), F.min("head").alias("first_head"), F.max("head").alias("last_head"),
        F.min("tail").alias("first_tail"), F.max("tail").alias("last_tail"), F.max_by("final", "piece").alias("final"),
    )
    order = Window.partitionBy("client").orderBy("block")
    before = F.lag(F.struct("last_tail", "final")).over(order)
    entered = F.coalesce(~before["final"] & (F.col("first_head.us") - before["last_tail"] < gap), F.lit(False))
    linked = blocks.withColumn("entered", entered)
    linked = linked.withColumn("runs_on", F.coalesce(F.lead("entered").over(order), F.lit(False))).withColumn("later", F.lead("block").over(order).isNotNull())
    inner = F.col("last_piece") > 0
    linked = linked.withColumn("open_head", F.last(F.when(inner | ~F.col("entered"), F.col("last_head")), True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    linked = linked.withColumn("first_end", F.first(F.when(inner | ~F.col("runs_on"), F.col("first_tail")), True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    return linked.select(
        "client", "block", "last_piece", "entered", "runs_on", "later", "first_end",
        F.when(F.col("entered"), F.lag("open_head").over(order)).otherwise(F.col("first_head")).alias("edge_head"),
        F.when(F.col("runs_on"), F.lead("first_end").over(order)).otherwise(F.col("last_tail")).alias("last_end"),
    )


def _islands(pieces: DataFrame, gap: int, longest: int) -> DataFrame:
    """Adds to each piece its island's head and tail, whether it is overlong or in several blocks, and what the next click
    meets after it (null where the island goes on)."""
    first, last = F.col("piece") == 0, F.col("piece") == F.col("last_piece")
    runs_on = last & F.col("runs_on")
    tail = F.when(first, F.col("first_end")).when(last, F.col("last_end")).otherwise(F.col("tail"))
    meets = F.when(runs_on, None).when(F.col("final"), "end").when(~last | F.col("later"), "gap").otherwise("none")
    found = pieces.join(_edges(pieces, gap), ["client", "block"]).select(
        "client", "block", "path", "cents", F.when(first, F.col("edge_head")).otherwise(F.col("head")).alias("head"),
        tail.alias("tail"), meets.alias("meets"), ((first & F.col("entered")) | runs_on).alias("shared"),
    )
    return found.withColumn("overlong", F.col("tail") - F.col("head.us") > longest)


def _starts(us: np.ndarray, longest: int) -> np.ndarray:
    """For each of the ascending times, the place of the first that is over `longest` later."""
    return np.searchsorted(us, us + longest, "right")


def _note(longest: int, reach: int, block: int):
    """Of one island and block, with the beginning of the next: where each click that could be the first new session of the
    block leads: the next block's first session, and the last session of this one."""

    def run(group: pa.Table) -> pa.Table:
        us, click = group["us"].to_numpy(), group["click"].to_numpy()
        order = np.lexsort((click, us))
        us, at = np.unique(us[order], return_index=True)
        click = click[order][at]
        here = group["block"][0].as_py()
        ends = (here + 1) * block
        own = int(np.searchsorted(us, ends))
        after = _starts(us, longest).tolist()
        to, last = [len(us)] * own, list(range(own))
        for i in range(own - 1, -1, -1):
            n = after[i]
            if n < own:
                to[i], last[i] = to[n], last[n]
            else:
                to[i] = n
        head = group["head_us"][0].as_py()
        could = np.flatnonzero(us[:own] == head) if head >= here * block else np.flatnonzero(us[:own] < here * block + reach)
        to, last = np.array(to, np.int64)[could], np.array(last, np.int64)[could]
        there = to < len(us)
        target = us[np.minimum(to, len(us) - 1)]
        n = len(could)
        return pa.table({
            "client": group["client"].take(pa.array(np.zeros(n, np.int64))), "island": pa.array(np.full(n, group["island"][0].as_py(), np.int64)),
            "block": pa.array(np.full(n, here, np.int64)), "at": pa.array(us[could]), "to": pa.array(target, pa.int64(), mask=~there),
            "past_us": pa.array(us[last]), "past_click": pa.array(click[last]),
        })

    return run


def _cut(longest: int):
    """Of one island and block, entered at a known session: the session of each click."""

    def run(group: pa.Table) -> pa.Table:
        us, click = group["us"].to_numpy(), group["click"].to_numpy()
        order = np.lexsort((click, us))
        group, us, click = group.take(pa.array(order)), us[order], click[order]
        begin_us, begin_click = np.empty(len(us), np.int64), np.empty(len(us), np.int64)
        entry = group["to"][0].as_py()
        i = len(us) if entry is None else int(np.searchsorted(us, entry))
        if i:
            begin_us[:i], begin_click[:i] = group["past_us"][0].as_py(), group["past_click"][0].as_py()
        while i < len(us):
            j = int(np.searchsorted(us, us[i] + longest, "right"))
            begin_us[i:j], begin_click[i:j], i = us[i], click[i], j
        out = group.select(["client", "us", "click", "cents", "meets"])
        return out.append_column("begin_us", pa.array(begin_us)).append_column("session", pa.array(begin_click))

    return run


def _cut_overlong(islands: DataFrame, client_type: str, longest: int, gap: int, block: int) -> DataFrame:
    """client, us, click, cents, meets, begin_us, session of the clicks of overlong islands; meets is "length" but for an island's last click."""
    key, reach = ["client", "island", "block"], longest + gap
    over = islands.where("overlong").select("client", "block", "meets", "tail", F.col("head.click").alias("island"), F.col("head.us").alias("head_us"), F.element_at("path", -1)["click"].alias("last"), F.inline("path"))
    over = over.withColumn("meets", F.when(F.col("meets").isNotNull() & (F.col("click") == F.col("last")), F.col("meets")).otherwise("length")).drop("last")
    edge = (F.col("us") - F.col("block") * block < reach) & (F.col("head_us") < F.col("block") * block)
    both = F.when(edge, F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block"))
    shown = over.select("client", "island", "head_us", "us", "click", F.explode(both).alias("block"))
    noted = shown.groupBy(*key).applyInArrow(_note(longest, reach, block), f"client {client_type}, island long, block long, at long, to long, past_us long, past_click long")
    hops = written(noted, "hops")
    none = F.lit(None).cast("long")
    entries = over.where("click = island").select("client", "island", "block", F.col("us").alias("to"), none.alias("past_us"), none.alias("past_click"))
    # the number of blocks that the longest island spans: one number for the driver
    span = over.agg(F.max(_block(F.col("tail"), block) - _block(F.col("head_us"), block))).head()[0] or 0
    for level in range(int(span).bit_length()):
        step = 1 << level
        onward = hops.select(*key, F.col("at").alias("to"), F.col("to").alias("then"), "past_us", "past_click")
        made = entries.drop("past_us", "past_click").join(onward, [*key, "to"])
        made = made.select("client", "island", (F.col("block") + step).alias("block"), F.col("then").alias("to"), "past_us", "past_click")
        entries = written(entries.unionByName(made), "entries")
        if step < span:
            first = hops.select("client", "island", "block", "at", "to").withColumn("block", F.col("block") + step)
            twice = first.join(onward, [*key, "to"])
            hops = written(twice.select("client", "island", (F.col("block") - step).alias("block"), "at", F.col("then").alias("to"), "past_us", "past_click"), "hops")
    placed = over.drop("tail", "head_us").join(entries, key)
    return placed.groupBy(*key).applyInArrow(_cut(longest), f"client {client_type}, us long, click long, cents long, meets string, begin_us long, session long")


def _late(starts: DataFrame, late: DataFrame, block: int) -> DataFrame:
    """client, begin_us, session, n_late: late clicks by the last session of their client that began before or with them.
    starts: client, begin_us, session; late: client, us."""
    begun = starts.select("client", F.col("begin_us").alias("us"), F.struct("begin_us", "session").alias("s"), F.lit(0).cast("long").alias("n"))
    counted = late.groupBy("client", "us").agg(F.count("*").alias("n"))
    events = begun.unionByName(counted, allowMissingColumns=True).withColumn("block", _block(F.col("us"), block))
    # a start sorts before late clicks of the same time, whose n is over 0
    inside = Window.partitionBy("client", "block").orderBy("us", F.col("n") > 0, "s.session").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.select("client", "block", "n", F.last("s", True).over(inside).alias("found"))
    order = Window.partitionBy("client").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = events.groupBy("client", "block").agg(F.max("s").alias("s")).select("client", "block", F.last("s", True).over(order).alias("earlier"))
    asked = seen.where("n > 0").groupBy("client", "block", "found").agg(F.sum("n").alias("n"))
    placed = asked.join(earlier, ["client", "block"]).withColumn("found", F.coalesce("found", "earlier")).where("found IS NOT NULL")
    return placed.groupBy("client", "found").agg(F.sum("n").alias("n_late")).select("client", "found.begin_us", "found.session", "n_late")


def sessions(clicks: DataFrame, final: Column, amount: Column, client: str = "client_id", click: str = "click_id", at: str = "ts", arrived: str = "arrived_at",
             gap: int = 15 * MINUTE, longest: int = 60 * MINUTE, lateness: int = 15 * MINUTE, block: int = 120 * MINUTE) -> DataFrame:
    """One row a session: client, session_id, start_us, end_us, n_clicks, n_late, total, closed_by, path_sha256.

    final and amount (a whole number) are expressions over clicks. Times are microseconds. block, by which time is dealt
    out to tasks, has to hold longest + gap, and changes no result.
    """
    if block < longest + gap:
        raise ValueError("a block must not be shorter than longest and gap together")
    kind = clicks.schema[client].dataType.simpleString()
    is_late = F.coalesce(F.col("wait") > lateness, F.lit(False))
    once = _once(clicks, client, click, at, arrived, final, amount).withColumn("block", _block(F.col("us"), block)).withColumn("late", is_late).drop("wait")
    pieces = written(_pieces(once, gap), "pieces")
    islands = written(_islands(pieces.where("NOT late"), gap, longest), "islands")
    short = islands.where("NOT overlong").select("client", F.col("head.us").alias("begin_us"), F.col("head.click").alias("session"), "path", "cents", "meets", "shared")
    whole = short.where("NOT shared").drop("shared")
    shared = short.where("shared").groupBy("client", "begin_us", "session").agg(F.sort_array(F.flatten(F.collect_list("path"))).alias("path"), F.sum("cents").alias("cents"), F.max("meets").alias("meets"))
    cut = _cut_overlong(islands, kind, longest, gap, block).groupBy("client", "begin_us", "session").agg(
        F.sort_array(F.collect_list(F.struct("us", "click", "cents"))).alias("path"), F.sum("cents").alias("cents"), F.max_by("meets", F.struct("us", "click")).alias("meets")
    )
    ids = F.transform("path", lambda c: F.nullif(c["click"], F.lit(NO_ID)).cast("string"))
    told = written(whole.unionByName(shared).unionByName(cut).select(
        "client", "begin_us", "session", F.element_at("path", -1)["us"].alias("end_us"), F.size("path").cast("long").alias("n_clicks"),
        F.col("cents").alias("total"), F.col("meets").alias("closed_by"), F.sha2(F.array_join(ids, ","), 256).alias("path_sha256"),
    ), "sessions")
    late = pieces.where("late").select("client", F.inline("path")).select("client", "us")
    behind = _late(told.select("client", "begin_us", "session"), late, block)
    return told.join(behind, ["client", "begin_us", "session"], "left").select(
        F.col("client").alias(client), F.nullif(F.col("session"), F.lit(NO_ID)).alias("session_id"), F.col("begin_us").alias("start_us"), "end_us",
        "n_clicks", F.coalesce("n_late", F.lit(0)).cast("long").alias("n_late"), "total", "closed_by", "path_sha256",
    )


def op12_sessions(spark, sf_dir: str) -> DataFrame:
    """All clicks in sessions: gaps of 15 minutes, 60 minutes at most, purchases and signups of 60 and more final."""
    clicks = reachable(spark).read.parquet(f"{sf_dir}/clicks.parquet")
    final = (F.col("value") >= 60) & F.col("kind").isin("purchase", "signup")
    return sessions(clicks, final, F.floor(100 * F.col("value") + 0.5)).withColumnRenamed("total", "value_cents")


QUERIES = {"op12_sessions": op12_sessions}

#: Greedy cuts by recursion from each island's head.
ORACLES = {
    "op12_sessions": """
WITH RECURSIVE raw AS (
  SELECT click_id AS k, min(client_id) AS c, min(epoch_us(ts)) AS us, coalesce(min(epoch_us(arrived_at)) - min(epoch_us(ts)) > 900000000, false) AS late,
         coalesce(min(value) >= 60 AND min(kind) IN ('purchase', 'signup'), false) AS fin, coalesce(CAST(floor(100 * min(value) + 0.5) AS BIGINT), 0) AS cents
  FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL GROUP BY click_id),
timely AS (
  SELECT *, row_number() OVER o AS n, lead(us) OVER o AS next_us, coalesce(lag(fin) OVER o OR us - lag(us) OVER o >= 900000000, true) AS hard
  FROM raw WHERE NOT late WINDOW o AS (PARTITION BY c ORDER BY us, k)),
isle AS (SELECT *, sum(CAST(hard AS INT)) OVER (PARTITION BY c ORDER BY n) AS i FROM timely),
spans AS (SELECT c, i, min(n) AS n, min(us) AS us, max(us) AS tail FROM isle GROUP BY c, i),
cut AS (
  SELECT c, i, n, us, tail FROM spans
  UNION ALL
  SELECT s.c, s.i, s.n, s.us, s.tail FROM (
    SELECT x.c, x.i, x.tail, min(y.n) AS n, min(y.us) AS us FROM cut x JOIN isle y ON y.c = x.c AND y.i = x.i AND y.us > x.us + 3600000000
    WHERE x.tail > x.us + 3600000000 GROUP BY x.c, x.i, x.tail) s),
begun AS (SELECT c, n AS first_n, us AS start_us, lead(n) OVER w AS stop_n, lead(us) OVER w AS stop_us FROM cut WINDOW w AS (PARTITION BY c ORDER BY n)),
told AS (
  SELECT b.c, b.first_n, b.start_us, any_value(b.stop_us) AS stop_us, arg_min(t.k, t.n) AS session_id, max(t.us) AS end_us, count(*) AS n_clicks, sum(t.cents) AS cents,
         arg_max(CASE WHEN t.fin THEN 'end' WHEN t.next_us IS NULL THEN 'none' WHEN t.next_us - t.us >= 900000000 THEN 'gap' ELSE 'length' END, t.n) AS closed_by,
         sha256(string_agg(CAST(t.k AS VARCHAR), ',' ORDER BY t.n)) AS path
  FROM begun b JOIN timely t ON t.c = b.c AND t.n >= b.first_n AND (b.stop_n IS NULL OR t.n < b.stop_n) GROUP BY b.c, b.first_n, b.start_us),
behind AS (
  SELECT t.c, t.first_n, count(*) AS n_late FROM told t JOIN raw r ON r.late AND r.c = t.c AND r.us >= t.start_us AND (t.stop_us IS NULL OR r.us < t.stop_us) GROUP BY t.c, t.first_n)
SELECT t.c AS client_id, t.session_id, t.start_us, t.end_us, t.n_clicks, coalesce(b.n_late, 0) AS n_late, CAST(t.cents AS BIGINT) AS value_cents, t.closed_by, t.path AS path_sha256
FROM told t LEFT JOIN behind b ON b.c = t.c AND b.first_n = t.first_n
"""
}
