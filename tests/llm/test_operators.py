"""The ten queries against brute force on a small table, and on empty and repeated rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from quernstone.llm import registry

QUERIES = registry.queries()


def run(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def name_of(n):
    return next(k for k in QUERIES if k.startswith(f"op{n}_"))


@pytest.mark.parametrize("n", range(1, 11))
def test_an_empty_table_gives_an_empty_result(spark, folders, n):
    assert run(spark, name_of(n), folders["empty"]) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 10])
def test_repeated_rows_and_null_ids_each_get_a_row(spark, folders, rows, n):
    found = Counter(r["doc_id"] for r in run(spark, name_of(n), folders["repeated"]) if r.get("piece", 0) == 0)
    assert found == Counter([i for i, _ in rows + rows[:9]] + [None])


def test_packing(spark, folders, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    found = {(r["doc_id"], r["piece"]): r for r in run(spark, name_of(1), folders["plain"])}
    total = 0
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k in range(-(-len(ids) // 2048)):
            part = ids[2048 * k : 2048 * (k + 1)]
            r = found.pop((i, k))
            assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * k, len(part), zlib.crc32(part.tobytes()))
            found[i, k, "seen"] = r
    assert all(len(k) == 3 for k in found)
    bins = {}
    for r in found.values():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 1


def test_packing_plan_fills_bins_best():
    from quernstone.llm.packing import fullest, plan

    assert sum(k * m for k, m in fullest({7: 2, 5: 3, 3: 1}, 16)) == 15
    made = plan({2048: 3, 1024: 5, 600: 4, 424: 4, 1: 7}, 2048)
    assert made.groupby("length")["count"].sum().to_dict() == {2048: 3, 1024: 5, 600: 4, 424: 4, 1: 7}
    assert (made["sequence"] + made["bins"]).max() == 8


def test_media(spark, folders, rows):
    by_text = {}
    for r in run(spark, name_of(2), folders["plain"]):
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        data = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert by_text.setdefault(raw, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_jpeg_scans_accumulate_to_the_coefficients():
    from quernstone.llm import jpeg

    rng = np.random.default_rng(1)
    for trial in range(25):
        w, h = (int(x) for x in rng.integers(1, 60, 2))
        parts = [jpeg.Component(1, int(rng.integers(1, 3)), int(rng.integers(1, 3)), 0), jpeg.Component(2, 1, 1, 0), jpeg.Component(3, 1, 1, 0)]
        jpeg.sized(w, h, parts)
        for c in parts:
            c.coefs = (rng.integers(-400, 400, (c.wide * c.high, 64)) * (rng.random((c.wide * c.high, 64)) < rng.random())).astype(np.int32) >> int(rng.integers(0, 6))
            outside = np.ones(c.wide * c.high, bool)
            outside[jpeg.own_order(c)] = False
            c.coefs[outside, 1:] = 0
        scans = [((0, 1, 2), 0, 0, 0, 1), *[s for k in range(3) for s in (((k,), 1, 5, 0, 2), ((k,), 6, 63, 0, 2), ((k,), 1, 63, 2, 1))], ((0, 1, 2), 0, 0, 1, 0), *[((k,), 1, 63, 1, 0) for k in range(3)]]
        image = jpeg.decode(jpeg.encode(w, h, parts, {0: np.ones(64, np.int32)}, scans))
        assert all((a.coefs == b.coefs).all() for a, b in zip(parts, image.components))
        assert jpeg.rgb(image).shape == (h, w, 3)
    with pytest.raises(jpeg.JpegError):
        jpeg.decode(b"\xff\xd8\xff\xc0\x00\x02")


def test_fingerprints(spark, folders, rows):
    order = sorted(rows, key=lambda r: -r[0])
    pieces = lambda t: set(re.findall(r"[^\n]{1,64}", t))
    like = lambda a, b: 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1
    found = {r["doc_id"]: r for r in run(spark, name_of(3), folders["plain"])}
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited, r = text[: len(text) - m] + after[:m], found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(pieces(text), pieces(edited)), abs=1e-12)
        assert r["near_next"] == pytest.approx(like(pieces(text), pieces(after)), abs=1e-12)


@pytest.mark.parametrize("n", [4])
def test_bpe(spark, folders, rows, n):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in run(spark, name_of(n), folders["plain"]):
        text = dict(rows)[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_language(spark, folders, rows):
    for r in run(spark, name_of(5), folders["plain"]):
        text = dict(rows)[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert (r["lang_pred"] == "und") == (not text or not any(c.isalpha() for c in text))
        assert 0 <= r["score"] <= 1


def test_languages_are_told_apart(spark):
    from quernstone.llm import language_id

    a, b = "the and of thing onion there", "der und nicht schön über ein"
    docs = spark.createDataFrame([(i, (a if i % 2 else b) + f" {i}", "x" if i % 2 else "y") for i in range(60)], "doc_id long, text string, lang string")
    found = language_id.predict(docs, language_id.learn(docs.where("doc_id < 30"), "lang", "doc_id", "text"), carry=("lang",)).collect()
    assert all(r.lang == r.lang_pred for r in found)
    assert {r.lang_pred for r in language_id.predict(docs, {}).collect()} == {"und"}


def test_token_counts(spark, folders, rows):
    import base64

    import public_tokenizers as P
    import tiktoken
    from quernstone.llm import token_counts

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = [len(enc.encode_ordinary(t or "")) for _, t in rows]
    found = run(spark, name_of(6), folders["plain"])
    assert {r["n_tokens"]: r["n_docs"] for r in found} == Counter(lengths)
    for r in found:
        at = r["n_tokens"]
        assert r["docs_at_least"] == sum(x >= at for x in lengths) and r["tokens_at_least"] == sum(x for x in lengths if x >= at)
        assert r["truncated_tokens"] == sum(min(x, at) for x in lengths) and r["quantile"] == pytest.approx(sum(x <= at for x in lengths) / len(lengths))
    limits = {r.limit: (r.docs_over, r.truncated_tokens) for r in token_counts.answer(QUERIES[name_of(6)](spark, folders["plain"]), [0, 10, 777]).collect()}
    assert limits == {k: (sum(x > k for x in lengths), sum(min(x, k) for x in lengths)) for k in (0, 10, 777)}


def brute_cut(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for k in range(len(words) - 19):
            w = tuple(words[k : k + 20])
            if w in seen:
                gone.update(range(k, k + 20))
            seen.add(w)
        out[i] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def test_substring_dedup(spark, folders, rows):
    expected = brute_cut(rows)
    assert sum(v[1] for v in expected.values()) > 100
    for r in run(spark, name_of(7), folders["plain"]):
        n, gone, kept = expected[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_pii(spark, folders, rows):
    for r in run(spark, name_of(8), folders["plain"]):
        base = base_spans(dict(rows)[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b.startswith(k) for b in base) for k in ("email", "ip", "card", "phone")]
        assert set(base) <= set(r["spans"].split(",")) | {""}


def test_pii_base_finders_equal_the_patterns_on_noise():
    import random

    from quernstone.llm import pii

    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choice(["a", "1", "23", ".", "@", "-", " ", "+", "(", ")", "b.c", "4", "255", "%", "é"]) for _ in range(rng.randrange(1, 30)))
        assert [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e, base, _ in pii.candidates(text) if base] == base_spans(text)
    assert pii.candidates("1" * 200_000) == [] and pii.candidates("a" * 200_000 + "@") == []


def brute_components(rows):
    sets, parent = {}, {i: i for i, _ in rows}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_dedup(spark, folders, rows):
    expected = brute_components(rows)
    assert len({v[1] for v in expected.values()}) <= len(rows) - 8
    for r in run(spark, name_of(9), folders["plain"]):
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (*expected[r["doc_id"]], expected[r["doc_id"]][1] == r["doc_id"])


def test_sketches_merge_and_estimate():
    from quernstone.llm import near_dedup as nd

    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 62, 4000).astype(np.uint64), rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    u = np.unique(np.concatenate([a, b]))
    assert (np.maximum(nd.sketch(a), nd.sketch(b)) == nd.sketch(u)).all()
    found = nd.estimate(nd.sketch(a)[None], nd.sketch(u)[None], np.array([4000.0]), np.array([5000.0]))[0]
    assert abs(found - 0.8) < 0.15


def test_components(spark):
    from quernstone.llm.components import components

    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(300, 200), (200, 300), (7, 7)]
    found, again = ({r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), small).collect()} for small in (0, 1000))
    assert found == again == {**{k: 100 for k in range(100, 161)}, **{k: 5 for k in range(5, 40)}, 200: 200, 300: 200}


def test_sharding(spark, folders, rows):
    key = lambda t: int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)
    size = {i: len((t or "").encode()) + 16 for i, t in rows}
    order = sorted(rows, key=lambda r: (key(r[1]), r[0]))
    total, at, slots = sum(size.values()), 0, Counter()
    expected = {}
    for i, t in order:
        shard = min(39, at * 40 // total)
        expected[i] = (size[i], zlib.crc32((t or "").encode()), shard, slots[shard])
        slots[shard] += 1
        at += size[i]
    for r in run(spark, name_of(10), folders["plain"]):
        assert (r["size"], r["text_crc32"], r["shard"], r["slot"]) == expected[r["doc_id"]]
        assert (r["law"], r["grown_shard"]) == ("bytes", None)


def test_overfull_ranges_are_subdivided(spark):
    from quernstone.llm import sharding

    df = spark.range(4000).selectExpr("IF(id < 1500, 7L, id * 1000003 % 99991) AS k1", "id AS k2", "IF(id = 3999, 5000L, 10L) AS size").cache()
    bounds, totals = sharding.splitters(df, 16)
    assert sum(b for b, _ in totals) == 44990 and sum(n for _, n in totals) == 4000
    assert max(b for b, n in totals if n > 1) < 3 * 44990 / 16 + 5000
