"""What the review of the first round found missing in the pipeline."""

import sys

import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_texts_that_share_an_id(spark):
    """Other texts of an id stay and are searched for links and repeats; only rows that repeat id and text go."""
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    shared = words("again", 40)
    a, b, c = words("a", 60), words("b", 60), words("c", 60)
    rows = [(-5, a), (1, a), (1, b), (1, b), (2, b + " more"), (3, c), (3, c + " more"), (4, words("d", 60) + " " + shared), (4, words("e", 60) + " " + shared), (None, a)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    once = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    pairs = sorted(((r.doc_id, r.text) for r in once.collect()), key=str)
    assert once.columns == docs.columns
    left = [p for p in pairs if p[0] != 3]
    assert left == sorted([(-5, a), (1, b), rows[7], rows[8], (None, a)], key=str)
    assert [t in (c, c + " more") for i, t in pairs if i == 3] == [True]

    cut = corpus_pipeline.cut_repeats(spark, once, "").collect()
    texts = [r.text for r in cut if r.doc_id == 4]
    assert len(cut) == len(pairs) and len(texts) == 2 and sum(shared in t for t in texts) == 1
    assert {t.split()[0] for t in texts} == {"d0", "e0"} and all(r.n_chars == len(r.text) for r in cut)
