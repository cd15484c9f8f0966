"""The pipeline's stages on the small table: each against brute force on its own input."""

import re
import sys

import pytest

from .test_operators import base_spans, brute_components, brute_cut

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", ["plain", "repeated"])
def test_stages(spark, folders, name):
    from quernstone.llm.common import documents, written

    docs = documents(spark, folders[name])
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    read = pairs(docs)

    known = written(stages["language_id"](spark, docs, folders[name]), "a")
    assert known.columns == docs.columns
    assert pairs(known) == [p for p in read if p[1] and any(c.isalpha() for c in p[1])]

    once = written(stages["near_dedup"](spark, known, folders[name]), "b")
    ids = {i: t for i, t in pairs(known) if i is not None}
    left = {i for i, (_, c) in brute_components(list(ids.items())).items() if c == i}
    assert [i for i, _ in pairs(once) if i is not None] == sorted(left, key=lambda i: str((i, ids[i]))) and once.columns == docs.columns

    cut = written(stages["substring_dedup"](spark, once, folders[name]), "c")
    expected = brute_cut([(i, t) for i, t in pairs(once) if i is not None])
    for i, text in pairs(cut):
        if i is not None:
            n, gone, kept = expected[i]
            assert text == (kept if gone else ids[i])

    clean = written(stages["pii"](spark, cut, folders[name]), "d")
    for (i, before), (j, after) in zip(pairs(cut), pairs(clean), strict=True):
        assert i == j or str(i) != str(j)
    texts = dict(pairs(clean))
    for i, before in pairs(cut):
        if not base_spans(before):
            assert texts[i] == before or re.search(r"<(EMAIL|PHONE)>", texts[i])
        else:
            assert not base_spans(texts[i])
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    packed = stages["packing"](spark, clean, folders[name]).collect()
    assert {r.doc_id for r in packed} == set(texts)


def test_run(spark, folders):
    assert corpus_pipeline.run(spark, folders["plain"]).count() > 0
    assert corpus_pipeline.run(spark, folders["empty"]).count() == 0
