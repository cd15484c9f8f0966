import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def passage(rng, n):
    return " ".join(rng.choice(["alpha", "béta", "gamma", "delta", "eps", "zeta,", "Eta.", "theta", "iota", "kappa"]) + str(rng.randrange(60)) for _ in range(n))


def fixture_rows():
    """Documents with nulls, blanks, copies, near copies, shared passages, personal data and a long text."""
    rng = random.Random(5)
    texts = [passage(rng, rng.randrange(5, 200)) for _ in range(40)]
    base, shared = passage(rng, 120), passage(rng, 60)
    for k in range(12):
        words = base.split()
        for _ in range(k):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
        texts.append(" ".join(words))
    texts += [texts[3]] * 5 + [f"{passage(rng, 30)}\n{shared} {passage(rng, 20)}" for _ in range(4)] + [f"{shared} {shared}"]
    texts += ["", " \t\n ", "one two", "one two three four", "!!! 123 ???", "ünïcode ß ſ 𝒳𝒳 日本語 テキスト", "x" * 3000, passage(rng, 6000), None, None]
    texts += ["mail a.b@c-d.example.org or x@y@z.com, ip 10.0.0.1 and 999.1.1.1, card 4242 4242 4242 4242 or 4242424242424243, call +1 (202) 555-0101 or (202) 555-0102"]
    return [(i, t) for i, t in enumerate(texts)]


def table(rows):
    """Rows as a documents table, with further columns whose names the operators use inside."""
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    n = len(rows)
    own = {
        "doc_id": pa.array(ids, pa.int64()),
        "text": pa.array(texts, pa.string()),
        "lang": pa.array([("en", "de", None)[k % 3] for k in range(n)], pa.string()),
        "source": pa.array([None if k % 5 == 0 else f"s{k % 4}" for k in range(n)], pa.string()),
        "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
    }
    clash = {c: pa.array([hashlib.md5(f"{c}{k}".encode()).hexdigest() for k in range(n)]) for c in ("id", "size", "key", "place", "range", "rank", "digest", "kept", "score", "found", "length", "seed", "cuts", "_kept", "_lang_pred", "_lang_score", "_text", "_node", "variant", "lang_pred", "node", "n_words", "_pii_id")}
    return pa.table(own | clash)


@pytest.fixture(scope="session")
def rows():
    return fixture_rows()


@pytest.fixture(scope="session")
def folders(tmp_path_factory, rows):
    """The fixture, the fixture with repeated rows and a null id, and an empty table."""
    out = {}
    for name, own in {"plain": rows, "repeated": rows + rows[:9] + [(None, "a null id with some words in it")], "empty": []}.items():
        d = tmp_path_factory.mktemp(name)
        pq.write_table(table(own), d / "documents.parquet")
        out[name] = f"file://{d}"
    return out
