"""Best-fit packing by minimum bin slack.

Texts are encoded, cut at the capacity and counted by length. The plan is made over the counts alone: take the longest
length left, find by a subset-sum over a bitset of reachable totals the fullest combination of other lengths that are
left, and take that combination as often as the counts allow. The plan has a number of rows that depends on the capacity
only. Pieces of a length are ranked (ranks are salted, as a third of all pieces may share one length) and the plan tells
each rank its sequence and offset.

Defined results: a null text is empty, which is the end token alone; repeated rows each get their place; ties in rank
are settled by id and piece; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Merger
from .common import documents, written
from .word_cache import CHUNK_CHARS, WordCache, WordTable

#: What the fast path below knows of a tokenizer, its normaliser's steps and its split pattern.
STEPS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same rule for Arrow, whose class of white space is ASCII's without the vertical tab.
ARROW_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\x0b\x{85}\x{a0}\p{L}\p{N}]+"
#: Texts with characters beyond the Latin blocks go through the tokenizer as a whole, as do those with separators that
#: only Python takes for white space. Within them NFC changes nothing, and no match of the pattern holds white space.
BEYOND = "[^\x00-\x1b\x20-\u024f]"


class WordTokenizer:
    """Ids of whole texts by a tokenizers file; words of plain Latin texts are encoded once and remembered."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(file)
        self.whole.encode_special_tokens = True
        parts = json.loads(file)
        self.beyond = regex.compile(BEYOND).search
        steps = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
        rule = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] if parts["pre_tokenizer"] else ""
        self.merger = self._merger(parts["model"]) if steps == STEPS and rule == SPLIT else None
        self.cache = WordCache(self._split, self._merged, WordTable, 2 * CHUNK_CHARS)

    @staticmethod
    def _merger(model: dict) -> Merger | None:
        """Merging in numpy, for a model whose ids follow the order of its merges."""
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        pairs, last = {}, -1
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = vocab[a + b]
            if made <= last:
                return None
            last = pairs[vocab[a], vocab[b]] = made
        if not pairs or model["dropout"] or model["ignore_merges"] or model["byte_fallback"] or model["continuing_subword_prefix"]:
            return None
        return Merger(np.array([vocab[x] for x in letters], np.int64), np.array([vocab[x + suffix] for x in letters], np.int64), pairs)

    def ids(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order. Texts that the fast path doesn't know are encoded as a whole and not remembered."""
        apart: deque[bytes | None] = deque()

        def plain() -> Iterator[str]:
            for text in texts:
                whole = bool(text) and (self.merger is None or bool(self.beyond(text)))
                apart.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if whole else None)
                yield "" if whole else text or ""

        for found in self.cache.ids(plain()):
            whole = apart.popleft()
            yield found if whole is None else whole

    @staticmethod
    def _split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Words by the rule, with empty ones at a text's blank edges."""
        marked = pc.replace_substring_regex(pa.array([t.lower() for t in texts], pa.large_string()), ARROW_SPLIT, r"\0 ")
        words = pc.utf8_split_whitespace(marked)
        return words.flatten(), np.diff(words.offsets.to_numpy())

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of words; an empty one has none."""
        made = iter(self.merger.merge([w.encode() for w in words if w]))
        return [next(made) if w else b"" for w in words]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    spare = iter(range(256, 512))
    return [chr(i) if 33 <= i <= 126 or 161 <= i <= 172 or i >= 174 else chr(next(spare)) for i in range(256)]


_BUILT: dict[str, WordTokenizer] = {}


def built(file: str) -> WordTokenizer:
    key = hashlib.sha256(file.encode()).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = WordTokenizer(file)
    return _BUILT[key]


def pieces(df: DataFrame, tokenizer_path: str, capacity: int, end: int = 0, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every text, cut only where longer than capacity."""
    with open(tokenizer_path) as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = built(file.value)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["id"].tolist(), tokenizer.ids(batch["text"]), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] * keep_ids)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    kind = df.schema[id_column].dataType.simpleString()
    read = df.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text")
    return read.mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def fullest(counts: dict[int, int], space: int) -> list[tuple[int, int]]:
    """(length, times) of the available lengths whose total is the largest up to space, long ones first."""
    mask = (1 << (space + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= space), reverse=True):
        left, many = min(counts[length], space // length), 1
        while left > 0:
            take = min(many, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, many = left - take, 2 * many
        if reach >> space:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Rows (length, rank, count, sequence, bins, offset): `count` pieces of a length from `rank` on go to `bins` sequences
    from `sequence` on, at `offset` in each, and the next `bins` of them right after."""
    left = {k: n for k, n in histogram.items() if n}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        first = max(left)
        left[first] -= 1
        rest = {k: n for k, n in left.items() if n}
        combination = dict(fullest(rest, capacity - first))
        left[first] += 1
        combination[first] = combination.get(first, 0) + 1
        bins = min(left[k] // m for k, m in combination.items())
        offset = 0
        for k, m in sorted(combination.items(), reverse=True):
            rows.append((k, used[k], bins * m, sequence, bins, offset))
            used[k] += bins * m
            left[k] -= bins * m
            if not left[k]:
                del left[k]
            offset += k * m
        sequence += bins
    return pd.DataFrame(rows, columns=["length", "rank", "count", "sequence", "bins", "offset"], dtype="int64")


def ranked(cut: DataFrame) -> DataFrame:
    """Adds rank, gapless from 0 among the pieces of one length, without gathering a length in one task."""
    spark = cut.sparkSession
    salts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    # pieces that repeat an id and number are told apart by what they hold, so that a task run again ranks them alike
    ties = [c for c in ("start", "ids_crc32") if c in cut.columns]
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", *ties))
    numbered = salted.withColumn("inside", inside)
    return numbered.join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("salt", "before", "inside")


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and any others). cut is read more than once: write it first."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # capacity rows at most
    made = plan(histogram, capacity).sort_values(["length", "rank"])
    table = cut.sparkSession.sparkContext.broadcast({k: made[k].to_numpy() for k in made})
    columns = [c for c in cut.columns]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table.value
        keys = (t["length"] << 44) | t["rank"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            row = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            q = rank - t["rank"][row]
            out = batch[columns].copy()
            out["sequence_id"] = t["sequence"][row] + q % t["bins"][row]
            out["offset"] = t["offset"][row] + (q // t["bins"][row]) * length
            yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked(cut).mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(written(pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048), "pieces"), 2048)


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
