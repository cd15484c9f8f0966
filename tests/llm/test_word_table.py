"""Words of op1: split in Arrow, remembered in columns."""

import zlib

import numpy as np


def tokenizer():
    import public_tokenizers
    from quernstone.llm import packing

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        return packing.WordTokenizer(f.read())


def test_packing_merges_a_word_once_while_columns_hold_it():
    """Words of two hundred thousand kinds, met twice."""
    found = tokenizer()
    letters = np.array(list("abcdefghijklmnopqrst"))
    words = ["".join(letters[[i % 20, i // 20 % 20, i // 400 % 20, i // 8000 % 20, i // 160000]]) for i in range(200_000)]
    text, asked, merge = " ".join(words), [], found.merger.merge
    found.merger.merge = lambda x: asked.append(len(x)) or merge(x)
    first = list(found.ids([text]))
    assert sum(asked) == len(words)
    assert list(found.ids([text])) == first
    assert sum(asked) == len(words)


def test_packing_splits_by_the_rule_in_arrow():
    """Every character that isn't sent through the library as a whole, in several places."""
    found = tokenizer()
    assert found.merger
    marks = [chr(i) for i in range(0x250) if not found.beyond(chr(i))]
    texts = [t for c in marks for t in (f"{c}", f"a{c}b {c}{c}9{c}1", f"'{c}s it'{c} x'S{c} {c}'re", f"{c} \n{c}.{c}?")] + ["", " ", "we'll \"'s' 's's 12 l'été ǅ ẞ İi", None]
    want = [np.array(found.whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(found.ids(texts)) == want


def test_a_table_of_words_stays_under_its_limit():
    import pyarrow as pa
    from quernstone.llm.word_cache import WordTable

    asked = []
    table = WordTable(lambda words: [asked.append(w) or zlib.crc32(w.encode()).to_bytes(4, "little") * (len(w) % 3) for w in words], 20_000)
    for k in range(200):
        words = ["often", "", *[f"rare{k}.{i}" for i in range(20)]]
        flat, starts, sizes = table.look(pa.array(words, pa.large_string()))
        for w, a, n in zip(words, starts, sizes, strict=True):
            assert flat[a : a + n].tolist() == [zlib.crc32(w.encode())] * (len(w) % 3)
        assert len(table.words) < 600
    assert asked.count("often") == 1
