"""Document fingerprints as invertible Bloom lookup sketches, with SQL functions only.

A text's paragraphs (lines, cut every 64 characters) are hashed to digests that carry their own checksum. A sketch has
three groups of cells; each digest is counted and XORed into one cell of each group. Sketches of two versions subtract
cell by cell, which cancels what they share; then cells with a single digest are peeled off, round by round, until the
sketch is empty and the digests that differ are known. A sketch that isn't emptied is retried larger: digests are dealt
to blocks of a few each, and blocks that fail are sketched again with four times the cells.

The likeness of two versions is the share of digests that didn't differ, 1 - differing / (digests of both).

Defined results: a null text is empty and has no digests; two empty texts are alike (1); a paragraph that occurs again
in a text counts once; rows that repeat an id follow each other by text; a null id comes after all others; with one
document, it is its own next; an empty table gives an empty result; other columns are not read. Equal texts have equal
fingerprints. Blocks that four sizes don't empty (digests that agree in the 30 bits that deal them to cells) are compared as sets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, text_or_empty, written
from .sharding import range_index, splitters

#: Cells in each of the three groups of a fingerprint; then of the retries, for each block.
CELLS, RETRIES = 8, (8, 32, 128, 1024)
#: Digests in a block (expected), rounds of peeling, and characters in a piece of a line.
BLOCK, ROUNDS, PIECE = 5, 12, 64
#: Bits of a digest that check the others.
CHECK = 24
#: Bytes of text that follow each other in one window partition.
STRETCH = 16 << 20


def digests(text: str) -> str:
    """SQL for the distinct digests of a text: 40 bits of hash and their 24-bit checksum."""
    pieces = f"regexp_extract_all({text}, '[^\\\\n]{{1,{PIECE}}}', 0)"
    return f"array_distinct(transform({pieces}, p -> {_checked('xxhash64(p)')}))"


def _checked(h: str) -> str:
    return f"(shiftleft(shiftright({h}, {CHECK}), {CHECK}) | (xxhash64(shiftright({h}, {CHECK})) & {(1 << CHECK) - 1}L))"


def _hits(items: str, group: int, place: str, size: int, var: str) -> str:
    """The items that go to a place of a group of cells; the group is known here, so that little is left to do for each."""
    return f"filter({items}, {var} -> {_goes(var, group, size)} = {place})"


def _goes(item: str, group: int, size: int) -> str:
    """The place of an item in a group of cells; each group takes ten bits of its own."""
    return f"(shiftright({item}, {CHECK + 10 * group}) & {size - 1}L)"


def _xor(items: str, var: str) -> str:
    return f"aggregate({items}, 0L, (q{var}, {var}) -> q{var} ^ {var})"


NOTHING = "named_struct('n', 0, 'k', 0L)"


def sketch(items: str, size: int) -> str:
    """SQL for the cells (n, k) of a set of digests, one group after the other."""
    # most cells of a block stay empty; they share one constant
    let = lambda j: f"transform(array({_hits(items, j, 'c', size, 'x')}), h -> if(size(h) = 0, {NOTHING}, named_struct('n', size(h), 'k', {_xor('h', 'y')})))[0]"
    return f"concat({', '.join(f'transform(sequence(0L, {size - 1}L), c -> {let(j)})' for j in range(3))})"


def sums(items: str, size: int) -> str:
    """SQL for the cells' XORs alone, which is all that peeling needs of sketches that aren't kept."""
    group = lambda j: f"transform(sequence(0L, {size - 1}L), c -> aggregate({items}, 0L, (q, x) -> if({_goes('x', j, size)} = c, q ^ x, q)))"
    return f"concat({', '.join(map(group, range(3)))})"


def subtracted(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (u, v) -> u ^ v)"


def _pure(c: str, i: str, size: int) -> str:
    """Whether a cell holds a single digest: its checksum fits and the digest belongs in this cell."""
    own = f"(shiftright({c}, {CHECK} + 10 * ({i} div {size})) & {size - 1}L) = {i} % {size}"
    return f"({c} <> 0L AND {own} AND ({c} & {(1 << CHECK) - 1}L) = (xxhash64(shiftright({c}, {CHECK})) & {(1 << CHECK) - 1}L))"


def peeled(cells: str, size: int) -> str:
    """SQL for (cells, differ): what peeling leaves of the XORs, and how many digests it recovered.

    A cell of several digests that passes for a single one (a chance below 2**-26) leaves the sketch unemptied, and it is
    retried.
    """
    less = lambda j: f"transform(slice(s.cells, {1 + j * size}, {size}), (c, i) -> aggregate(r, c, (q, x) -> if({_goes('x', j, size)} = i, q ^ x, q)))"
    taken = f"named_struct('cells', concat({', '.join(map(less, range(3)))}), 'differ', s.differ + size(r), 'live', true)"
    pure = f"array_distinct(filter(s.cells, (c, i) -> {_pure('c', 'i', size)}))"
    turn = f"transform(array({pure}), r -> if(size(r) = 0, named_struct('cells', s.cells, 'differ', s.differ, 'live', false), {taken}))[0]"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'differ', 0, 'live', true), (s, _i) -> if(s.live, {turn}, s))"


EMPTY = "forall({}.cells, c -> c = 0L)"


def blocks(sets: list[str]) -> str:
    """SQL for the sets dealt to blocks (x0, x1, ...) by a hash of the digest, in two steps so that it stays cheap."""
    side = f"cast(ceil(sqrt(greatest(1, {', '.join(f'size({x})' for x in sets)}) / {BLOCK})) AS int)"
    part = lambda of, n, v: f"filter({of}, x -> pmod(xxhash64(x, {n}), d) = {v})"
    made = lambda of, n, v: "named_struct(" + ", ".join(f"'x{i}', {part(x, n, v)}" for i, x in enumerate(of)) + ")"
    rows = f"transform(sequence(0, d - 1), g -> {made(sets, 1, 'g')})"
    inner = made([f"t.x{i}" for i in range(len(sets))], 2, "g")
    return f"transform(array({side}), d -> flatten(transform({rows}, t -> transform(sequence(0, d - 1), g -> {inner}))))[0]"


def with_differing(df: DataFrame, own: str, own_cells: str, others: list[tuple[str, str, str]]) -> DataFrame:
    """Adds for each other (name, set, cells) the number of digests in one of the two sets only.

    First the fingerprints themselves are peeled; what they don't recover is retried block by block, with all sets dealt
    to the same blocks, and blocks that fail are retried larger.
    """
    key = lambda cells: f"transform({cells}, c -> c.k)"
    df = df.select("*", *[F.expr(peeled(subtracted(key(own_cells), key(x)), CELLS)).alias(f"_p{w}") for w, (_, _, x) in enumerate(others)])
    solved = [EMPTY.format(f"_p{w}") for w in range(len(others))]
    dealt = blocks([own, *[x for _, x, _ in others]])
    df = df.select("*", F.expr(f"if({' AND '.join(solved)}, filter({dealt}, x -> false), {dealt})").alias("_b"))
    size = RETRIES[0]
    peels = ", ".join(f"'s{w}', {peeled(subtracted('z', sums(f'e.x{w + 1}', size)), size)}" for w in range(len(others)))
    df = df.select("*", F.expr(f"transform(_b, e -> transform(array({sums('e.x0', size)}), z -> named_struct('e', e, {peels}))[0])").alias("_r0"))
    done = lambda w: EMPTY.format(f"r.s{w}")
    left = ", ".join(f"if({solved[w]}, array(), transform(filter(_r0, r -> NOT {done(w)}), r -> named_struct('w', {w}, 'a', r.e.x0, 'b', r.e.x{w + 1})))" for w in range(len(others)))
    count = [f"if({solved[w]}, _p{w}.differ, aggregate(filter(_r0, r -> {done(w)}), 0, (q, r) -> q + r.s{w}.differ))" for w in range(len(others))]
    df = df.select("*", F.expr(f"concat({left})").alias("_b1"), *[F.expr(x).alias(f"_n1_{w}") for w, x in enumerate(count)])
    for k, size in enumerate(RETRIES[1:], 1):
        state = peeled(subtracted(sums("e.a", size), sums("e.b", size)), size)
        df = df.select("*", F.expr(f"transform(_b{k}, e -> named_struct('e', e, 's', {state}))").alias(f"_r{k}"))
        found = [F.expr(f"_n{k}_{w} + aggregate(filter(_r{k}, r -> r.e.w = {w} AND {EMPTY.format('r.s')}), 0, (q, r) -> q + r.s.differ)").alias(f"_n{k + 1}_{w}") for w in range(len(others))]
        df = df.select("*", F.expr(f"transform(filter(_r{k}, r -> NOT {EMPTY.format('r.s')}), r -> r.e)").alias(f"_b{k + 1}"), *found)
    k = len(RETRIES)
    rest = lambda w: f"aggregate(filter(_b{k}, e -> e.w = {w}), 0, (q, e) -> q + size(array_except(e.a, e.b)) + size(array_except(e.b, e.a)))"
    return df.select("*", *[F.expr(f"_n{k}_{w} + {rest(w)}").alias(name) for w, (name, _, _) in enumerate(others)])


def likeness(a: str, b: str, differ: str) -> str:
    both = f"(size({a}) + size({b}))"
    return f"if({both} = 0, 1D, 1D - {differ} / {both})"


def shown(cells: str) -> str:
    return f"concat_ws('', transform({cells}, c -> concat(lpad(hex(c.n), 4, '0'), lpad(hex(c.k), 16, '0'))))"


def with_next(df: DataFrame) -> DataFrame:
    """Adds next, the text that follows in descending id (after the last comes the first), to id and text.

    Ranges of ids of a bounded number of bytes are ordered each by itself; the first rows of a range are also put, as
    marks, at the end of the range before it. A column range stays, by which the rows are partitioned.
    """
    keyed = df.withColumn("k1", F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))).withColumn("k2", F.lit(0).cast("long"))
    sizes = written(keyed.select("k1", "k2", (F.octet_length("text") + 1).cast("long").alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / STRETCH))
    bounds, _ = splitters(sizes, parts)
    where = range_index(bounds, F.col("k1"), F.col("k2"))
    tops = sorted((r[0], r[1]) for r in sizes.groupBy(where.alias("range")).agg(F.max("k1")).collect())  # one row a range
    ranges = where.cast("int")
    if tops:
        before = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}
        marks = F.create_map(*[F.lit(x).cast(t) for top, at in before.items() for x, t in ((top, "long"), (at, "int"))])[F.col("k1")]
        places = F.filter(F.array(F.struct(ranges.alias("range"), F.lit(False).alias("mark")), F.struct(marks.alias("range"), F.lit(True).alias("mark"))), lambda p: p["range"].isNotNull())
    else:
        places = F.array(F.struct(ranges.alias("range"), F.lit(False).alias("mark")))
    rows = keyed.withColumn("at", F.explode(places)).select("id", "text", "k1", "at.range", "at.mark")
    order = Window.partitionBy("range").orderBy("mark", F.desc("k1"), "text")
    return rows.withColumn("next", F.lead("text").over(order)).where(~F.col("mark")).select("range", "id", "text", "next")


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every whole text and its edited text, with their likenesses."""
    pairs = with_next(df.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text")))
    n = "length(text)"
    edited = pairs.withColumn("edited", F.expr(f"concat(substring(text, 1, {n} - {n} div 3), substring(next, 1, {n} div 3))"))
    items = edited.select(
        F.col("id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        *[F.expr(digests(c)).alias(a) for c, a in (("text", "d1"), ("edited", "d2"), ("next", "d3"))],
    )
    cells = items.select("*", *[F.expr(sketch(f"d{i}", CELLS)).alias(f"s{i}") for i in (1, 2, 3)])
    found = with_differing(cells, "d1", "s1", [("differ_edited", "d2", "s2"), ("differ_next", "d3", "s3")])
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.expr(shown("s1")).alias("fingerprint"),
        F.expr(shown("s2")).alias("edited_fingerprint"),
        F.expr(likeness("d1", "d2", "differ_edited")).alias("near_edited"),
        F.expr(likeness("d1", "d3", "differ_next")).alias("near_next"),
    )


def op3_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses to these and to the next documents."""
    return fingerprints(documents(spark, sf_dir))


QUERIES = {"op3_document_fingerprints": op3_document_fingerprints}
