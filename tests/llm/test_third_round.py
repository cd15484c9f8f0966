"""Segment-tree BPE, gap sessions and importance resampling against the library and brute force."""

import datetime
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from quernstone.llm import importance, registry, segment_bpe
from quernstone.llm import sessions as S

QUERIES = registry.queries()
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- segment-tree BPE -------------------------------------------------------------------------------------------------


def test_segment_tree_holds_the_leftmost_least():
    rng = random.Random(3)
    for n in (1, 2, 3, 7, 40):
        leaves = [rng.randrange(9) * n + i for i in range(n)]
        tree = segment_bpe.SegmentTree(list(leaves))
        for _ in range(60):
            at = rng.randrange(n)
            leaves[at] = int(segment_bpe.EMPTY) if rng.random() < 0.3 else rng.randrange(9) * n + at
            tree.put(at, leaves[at])
            assert tree.root == min(leaves)


@pytest.fixture(scope="module")
def coders():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return segment_bpe.TreeBPE(f.read()), Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_trees_encode_as_the_library_does(coders):
    own, library = coders
    rng = random.Random(4)
    texts = ["", " ", "a" * 5000, "ab" * 700 + "é" * 300, " " * 2000 + "x", "日本語" * 300, "<|endoftext|>", "x<|endoftext|> y <|endoftext|><|endoftext|>  z", "<|endoftext", "I'll we'Re\r\n\t x"]
    texts += ["".join(rng.choice("ab c'stre\n\t 12é日ſ<|>") for _ in range(rng.randrange(300))) for _ in range(200)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0xD000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(120))) for _ in range(150)]
    for text, raw in zip(texts, own.cache.ids(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == want
        assert own.decode(np.array(want, np.int64)) == library.decode(want, skip_special_tokens=False)


def test_one_tree_and_a_matrix_of_trees_merge_alike(coders):
    own, _ = coders
    rng = random.Random(5)
    raws = [bytes(rng.choice(b"abcdehinorst ") for _ in range(rng.randrange(1, 128))) for _ in range(400)]
    assert own.merges.merge(raws) == [own.merges._alone(r) for r in raws]


def test_bpe_query(spark, folders, rows, coders):
    _, library = coders
    found = {r["doc_id"]: r for r in rows_of(QUERIES["op11_segment_tree_bpe"](spark, folders["plain"]))}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[i] == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha(",".join(map(str, ids))), "decoded_sha256": sha(library.decode(ids, skip_special_tokens=False))}
    assert len(found) == len(rows)
    assert rows_of(QUERIES["op11_segment_tree_bpe"](spark, folders["empty"])) == []
    assert len(rows_of(QUERIES["op11_segment_tree_bpe"](spark, folders["repeated"]))) == len(rows) + 10


def test_bpe_can_keep_ids_and_refuses_other_tokenizers(spark, folders, coders):
    import public_tokenizers as P

    docs = spark.createDataFrame([("a", "some text")], "key string, body string")
    kept = segment_bpe.encode(docs, P.path("byte_bpe_50k.json"), "key", "body", keep_ids=True).head()
    assert kept["id"] == "a" and kept["ids"] == coders[1].encode("some text").ids
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError, match="byte-level"):
        segment_bpe.TreeBPE(f.read())


# --- sessions ---------------------------------------------------------------------------------------------------------

BASE = 1_704_067_200_000_000


def brute(clicks, gap=15 * S.MINUTE, longest=60 * S.MINUTE, lateness=15 * S.MINUTE):
    """click rows (click, client, us, came, final, cents) -> sessions."""
    once, out = {}, []
    for r in sorted(clicks, key=lambda r: (r[0] is not None, r[0] or 0, r[3] is not None, r[3] or 0, r[2] or 0)):
        if r[1] is not None and r[2] is not None:
            once.setdefault(r[0], r)
    late = [r for r in once.values() if r[3] is not None and r[3] - r[2] > lateness]
    for client in {r[1] for r in once.values()}:
        mine = sorted((r for r in once.values() if r[1] == client and r not in late), key=lambda r: (r[2], r[0] is not None, r[0] or 0))
        made = []
        for r in mine:
            why = None
            if made:
                last = made[-1][-1]
                why = "end" if last[4] else "gap" if r[2] - last[2] >= gap else "length" if r[2] - made[-1][0][2] > longest else None
                if why is None:
                    made[-1].append(r)
                    continue
                closed.append(why)
            else:
                closed = []
            made.append([r])
        if made:
            closed.append("end" if made[-1][-1][4] else "none")
        for k, s in enumerate(made):
            stop = made[k + 1][0][2] if k + 1 < len(made) else math.inf
            out.append((client, s[0][0], s[0][2], s[-1][2], len(s), sum(r[1] == client and s[0][2] <= r[2] < stop for r in late), sum(r[5] or 0 for r in s), closed[k], sha(",".join(str(r[0]) for r in s if r[0] is not None))))
    return sorted(out, key=str)


def planted(seed=7):
    """Short and long islands, ones that cross many blocks, ties, finals, late and repeated clicks, nulls, one client with most."""
    rng, rows, k = random.Random(seed), [], 0
    for client in range(8):
        us = BASE + rng.randrange(200) * S.MINUTE
        for _ in range(12 if client else 40):
            step = rng.choice([1, 3, 14]) * S.MINUTE
            for _ in range(rng.choice([1, 2, 5, 30, 120])):
                us += rng.choice([0, 1, step - 1, step])
                came = us + rng.choice([0, S.MINUTE, 15 * S.MINUTE, 15 * S.MINUTE + 1] if rng.random() < 0.1 else [0])
                rows.append((k, client, us, came, rng.random() < 0.02, rng.choice([None, -3, 250, 999])))
                k += 1
            us += rng.choice([15 * S.MINUTE, 15 * S.MINUTE - 1, 60 * S.MINUTE, 60 * S.MINUTE + 1, 400 * S.MINUTE])
    rows += rng.sample(rows, 40)
    rows += [(k, None, BASE, BASE, False, 1), (k + 1, 3, None, BASE, True, 1), (k + 2, 9, BASE, None, True, 5), (k + 3, 10, BASE, BASE + 10**10, False, 5), (None, 11, BASE, BASE, False, 7), (None, 11, BASE, BASE, False, 7)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    made = spark.createDataFrame([(*r, "x") for r in rows], "click_id long, client_id long, us long, came long, final boolean, cents long, head string")
    return made.select("*", F.timestamp_micros("us").alias("ts"), F.timestamp_micros("came").alias("arrived_at"), F.lit(1).alias("block"), F.lit("y").alias("session"))


@pytest.mark.parametrize("block", [75, 120])
def test_sessions_equal_brute_force(spark, block):
    rows = planted()
    found = S.sessions(frame(spark, rows), F.col("final"), F.col("cents"), block=block * S.MINUTE)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows)


def test_one_island_of_many_days(spark):
    """An island over hundreds of blocks, whose cuts depend on all before them."""
    rng, us, rows = random.Random(2), BASE, []
    for k in range(4000):
        us += rng.randrange(1, 13 * S.MINUTE)
        rows.append((k, 1, us, us, False, 1))
    found = sorted((tuple(r) for r in S.sessions(frame(spark, rows), F.col("final"), F.col("cents")).collect()), key=str)
    assert found == brute(rows) and len(found) > 300


def test_sessions_of_no_clicks_and_short_blocks(spark):
    empty = frame(spark, planted()).limit(0)
    assert S.sessions(empty, F.col("final"), F.col("cents")).collect() == []
    with pytest.raises(ValueError, match="block"):
        S.sessions(empty, F.col("final"), F.col("cents"), block=S.MINUTE)


def test_sessions_query_reads_times_without_a_zone(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 0, 0, 0, 1)
    rows = {"click_id": [1, 2, 2], "ts": [at, at + datetime.timedelta(minutes=1), at + datetime.timedelta(minutes=1)], "client_id": [5, 5, 5], "kind": ["view", "signup", "signup"], "value": [1.005, 60.0, 60.0], "props": ["{}"] * 3}
    pq.write_table(pa.table(rows | {"arrived_at": rows["ts"]}), tmp_path / "clicks.parquet")
    assert rows_of(QUERIES["op12_sessions"](spark, f"file://{tmp_path}")) == [
        {"client_id": 5, "session_id": 1, "start_us": BASE + 1, "end_us": BASE + 1 + S.MINUTE, "n_clicks": 2, "n_late": 0, "value_cents": math.floor(100 * 1.005 + 0.5) + 6000, "closed_by": "end", "path_sha256": sha("1,2")}
    ]


# --- importance resampling --------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text, longest=1):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def resampled(docs, target, longest=1):
    """Rows (doc, n_features, weight, score, rank), sorted; equal rows may swap ranks."""
    corpus, aim = np.zeros(10000, int), np.zeros(10000, int)
    for _, t in docs:
        np.add.at(corpus, split(t, longest)[1], 1)
    for t in target:
        np.add.at(aim, split(t, longest)[1], 1)
    gain = [math.floor(1000 * math.log((int(aim[b]) + 1) * (int(corpus.sum()) + 10000) / ((int(corpus[b]) + 1) * (int(aim.sum()) + 10000)))) for b in range(10000)]
    out = []
    for i, t in docs:
        n, found = split(t, longest)
        weight = sum(gain[b] for b in found)
        h = int(sha(f"2024:{'' if i is None else i}")[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2]))
    for rank, r in enumerate(able[: 10 * len(able) // 100], 1):
        r.append(rank)
    return sorted((tuple([*r[:4], r[5] if len(r) > 5 else None]) for r in out), key=str)


@pytest.mark.parametrize("kind", ["plain", "repeated", "empty"])
def test_importance_query(spark, folders, rows, kind):
    docs = {"plain": rows, "repeated": rows + rows[:9] + [(None, "a null id with some words in it")], "empty": []}[kind]
    target = ["béta ünïcode Eta.", "alpha1 alpha2 gamma3", None, rows[0][1]]
    pq.write_table(pa.table({"item_id": [1, 2, 3, 4], "text": target}), folders[kind].removeprefix("file://") + "/benchmark.parquet")
    found = QUERIES["op13_importance_resampling"](spark, folders[kind])
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == resampled(docs, target)


def test_importance_of_longer_runs_and_many_ties(spark):
    docs = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(20 + i % 30))) for i in range(300)] + [(7, "one same text " * 8)] * 60 + [(400, "x"), (401, "")]
    target = ["w1 w2 w3 w4", "same text"]
    made = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), longest=3)
    assert sorted((tuple(r) for r in made.collect()), key=str) == resampled(docs, target, 3)


# --- near duplicates of ids with several texts -------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["long", "string"])
def test_no_link_of_an_id_with_two_texts_is_lost(spark, kind):
    from quernstone.llm.near_dedup import near_duplicates

    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (-4, "quite another text of six words"), (1, a), (None, a)]
    docs = spark.createDataFrame(rows, "k long, t string").select(F.col("k").cast(kind).alias("k"), "t")
    as_kind = (lambda x: x) if kind == "long" else (lambda x: None if x is None else str(x))
    found = sorted(((r.id, r.component_id, r.kept) for r in near_duplicates(docs, "k", "t").collect()), key=str)
    want = [(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (-4, -4, True), (None, None, True)]
    assert found == sorted(((as_kind(i), as_kind(c), x) for i, c, x in want), key=str)
