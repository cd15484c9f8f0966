"""Cases that the second review asked for."""

import hashlib
import io
import random
import time
from types import SimpleNamespace

import numpy as np
import pytest

from .test_operators import brute_cut


def texts_of_one_id():
    rng = random.Random(9)
    words = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    shared = words(300)
    return [(1, f"{words(30)} {shared}"), (2, f"{words(10)} {shared} {words(25)}"), (2, words(60)), (2, words(60)), (3, shared), (3, shared), (None, shared), (4, None), (4, "")]


def test_repeats_in_texts_that_share_an_id(spark):
    """Each text of an id is a document; a repeat of 300 words goes as one path, and rows that repeat fare alike."""
    from quernstone.llm import substring_dedup

    rows = texts_of_one_id()
    df = spark.createDataFrame([(i, t, f"x{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, variant string")
    found = {r.variant: r for r in substring_dedup.cut(df).collect()}
    assert len(found) == len(rows) and set(df.columns) < set(next(iter(found.values())).asDict())
    alone = brute_cut([(k, t) for k, (i, t) in enumerate(rows) if i is not None])
    for k, (i, text) in enumerate(rows):
        n, gone, kept = alone[4 if k == 5 else k] if i is not None else (len(text.split()), 0, text)
        r = found[f"x{k}"]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
        assert r.kept == (kept if gone else None)


def test_unbranched_paths_compact_whatever_their_length():
    from quernstone.llm import substring_dedup as sd

    n = np.full(40, 13)
    first = np.cumsum(n) - n
    key = np.arange(41)
    a, b = sd.compacted(first * sd.PACK + n, key[:-1], key[1:])
    assert (a.tolist(), b.tolist()) == ([0], [520])
    key[20] = 99
    out = key[1:].copy()
    out[19] = 98
    a, b = sd.compacted(first * sd.PACK + n, key[:-1], out)
    assert (a.tolist(), b.tolist()) == ([0, 260], [260, 260])


def test_words_are_compared_and_not_their_hashes_alone(spark, monkeypatch):
    """With hashes that clash all the time nothing goes whose words differ."""
    from quernstone.llm import substring_dedup as sd

    words = [" ".join(f"{c}{k}" for k in range(20)) for c in "abc"]
    digests = [sd.Spans(t).digest(0, 1) for t in words]
    assert len(set(digests)) == 3 and sd.Spans("  " + words[0].replace(" ", "\t ")).digest(0, 1) == digests[0]


def test_language_of_texts_with_ever_new_trigrams():
    """Time stays in proportion when trigrams never come again, and vectors don't depend on what was read before."""
    from quernstone.llm import language_id

    rng = random.Random(2)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(2000)) for _ in range(60)]
    list(language_id.bundles(texts[:2]))
    took = []
    for part in (texts[:20], texts[20:40], texts[40:]):
        began = time.process_time()
        every = list(language_id.bundles(part))
        took.append(time.process_time() - began)
    assert max(took) < 5 * min(took) + 0.2
    assert (next(language_id.bundles(texts[-1:])) == every[-1]).all()
    long = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(70_000))
    keys, counts = language_id.trigrams(long)
    assert len(keys) > 2 * language_id.TRIGRAMS
    assert (next(language_id.bundles([long])) == counts[:9] @ language_id.bound(keys[:9]).astype(float) + counts[9:] @ language_id.bound(keys[9:]).astype(float)).all()


def test_the_stored_tensor_is_that_of_the_stored_file(spark):
    from quernstone.llm import jpeg, media

    df = spark.createDataFrame([(1, "some text " * 90), (2, None), (3, "é" * 500)], "doc_id long, text string")
    for r in media.media_column(df, keep=True).collect():
        image = jpeg.decode(bytes(r.media))
        rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3)
        assert (rgb == jpeg.rgb(image)).all() and hashlib.sha256(r.media).hexdigest() == r.media_sha256
        # the first 8 x 8 pixels by the transform's definition, in floating point; a chroma sample covers 2 x 2 of them
        k = np.arange(8)
        basis = np.sqrt(np.where(k == 0, 1 / 8, 2 / 8))[:, None] * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
        zigzag = sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (sum(p), p[1] if sum(p) % 2 == 0 else p[0]))
        planes = []
        for c in image.components:
            square = np.zeros((8, 8))
            for value, (u, v) in zip(c.coefs[0], zigzag):
                square[u, v] = value
            planes.append(np.clip(np.rint(basis.T @ square @ basis + 128), 0, 255))
        y, cb, cr = planes[0], *(np.repeat(np.repeat(p[:4, :4], 2, 0), 2, 1) - 128 for p in planes[1:])
        expected = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)
        assert abs(rgb[:8, :8] - expected).max() <= 3


def test_fingerprints_are_retried_until_they_are_peeled(spark):
    """Versions that differ far beyond a fingerprint's cells; equal texts have equal fingerprints."""
    from quernstone.llm import fingerprints

    lines = lambda a, b: "\n".join(f"line {k}" for k in range(a, b))
    rows = [(4, lines(0, 900)), (3, lines(300, 1500)), (2, lines(0, 900)), (1, "")]
    found = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[4].near_next == pytest.approx(1 - (300 + 600) / (900 + 1200), abs=1e-12)
    assert found[2].near_next == 0 and found[4].fingerprint == found[2].fingerprint != found[3].fingerprint


def test_a_cluster_needs_a_shared_folder():
    from quernstone.llm import common

    context = SimpleNamespace(getConf=lambda: {}, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(sparkContext=context, conf={}))


def test_words_are_remembered_within_a_bound():
    from quernstone.llm.word_cache import ENTRY, Remembered

    asked = []
    cache = Remembered(lambda words: [asked.append(w) or w.encode() for w in words], 100 * ENTRY)
    for k in range(2000):
        cache.learn({"often", f"rare{k}"} - cache.young.keys())
        cache.settle()
        assert len(cache.young) + len(cache.old) < 250
    assert asked.count("often") == 1 and len(asked) == 2001


def test_tokens_of_odd_white_space_and_letters():
    import public_tokenizers as P
    from quernstone.llm import packing

    tokenizer = packing.built(io.open(P.path("word_bpe_49k.json")).read())
    texts = ["", "  a  b ", "İstanbul ǅ \x85x\xa0y", "日本 x", "\x1cab c", "a\tb\nc\r\v\fd", "don't STOP 123 é ß", "x" * 5000]
    expected = [np.array(tokenizer.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(tokenizer.ids([None, *texts])) == [b"", *expected]
