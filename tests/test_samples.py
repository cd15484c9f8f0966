"""Samples against documents that really take turns."""

import hashlib
import random

from pyspark.sql import functions as F

from quernstone.operators import samples

md5 = lambda *parts: hashlib.md5("|".join(map(str, ("s", *parts))).encode()).hexdigest()
KEY = lambda *names: F.md5(F.concat_ws("|", F.lit("s"), *[F.col(n).cast("string") for n in names]))


def turns(points, count, classes):
    docs = {}
    for d, c, t, able in points:
        if able:
            docs.setdefault(d, {}).setdefault(t, []).append((c, able))
    queues = {}
    for d, kinds in docs.items():
        queues[d] = [(t, sorted(kinds[t], key=lambda x: (md5(x[0]), x[0]))) for t in sorted(kinds, key=lambda t: (md5(d, t), t))]  # noqa: B023
    out, given = [], dict.fromkeys(classes, 0)
    while len(out) < count and any(queues.values()):
        for d in sorted(docs, key=lambda d: (md5(d), d)):
            if len(out) < count and queues[d]:
                kind, held = queues[d].pop(0)
                chunk, able = held.pop(0)
                if held:
                    queues[d].append((kind, held))
                best = min((c for c in classes if c in able), key=given.__getitem__)
                given[best] += 1
                out.append((len(out) + 1, d, chunk, kind, best))
    return out


def test_documents_and_their_kinds_take_turns(spark):
    rng, classes = random.Random(3), ["a", "b", "c"]
    points = [(f"d{rng.choice([0, 0, 0, 1, 2, 3, 4])}", k, rng.choice("xyz"), [c for c in classes if rng.random() < 0.5]) for k in range(300)]
    df = spark.createDataFrame(points, "doc_id string, chunk_id long, chunk_type string, classes array<string>")
    for count in (0, 1, 37, 1000):
        found = sorted(map(tuple, samples.stratified(df, count, classes, KEY).collect()))
        assert found == turns(points, count, classes)
