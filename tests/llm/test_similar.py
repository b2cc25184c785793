"""Similar texts against brute force: links inside shards, hot shards, and recall at a Jaccard similarity of 0.8."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from keyloom.llm import components, simhash


def edited(words, share, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), max(1, int(share * len(out)))):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def texts():
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    out = []
    for size, copies in ((300, 120), (80, 40), (1000, 25), (150, 3)):
        base = fresh(size)
        out += [edited(base, rng.uniform(0, 0.05), rng) for _ in range(copies)]
    passage = fresh(60)
    out += [fresh(40) + passage + fresh(40) for _ in range(80)]
    out += [fresh(rng.randrange(1, 200)) for _ in range(100)] + [fresh(3)] * 2 + [[]] * 2
    return [" ".join(x) for x in out]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def groups(n, pairs):
    forest = simhash.Forest(n)
    for a, b in pairs:
        forest.join(a, b)
    return [forest.find(k) for k in range(n)]


def classes(labels):
    first = {}
    return [first.setdefault(x, k) for k, x in enumerate(labels)]


@pytest.mark.parametrize("cell", [8, 30, 2048])
def test_links_in_shards_are_exact(spark, cell):
    known = simhash.WordHashes()
    rows = {}
    for t in texts():
        fp, shards = simhash.wide_sketch(t.encode(), 5, known)
        rows.setdefault(fp.tobytes(), (fp, shards))
    fps = [fp for fp, _ in rows.values()]
    shards = [set(x.tolist()) for _, x in rows.values()]
    reach = simhash.radius_of(0.8)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if shards[a] & shards[b] and int(np.bitwise_count(fps[a] ^ fps[b]).sum()) <= reach]
    want = classes(groups(len(fps), pairs))
    names = [b"%016d" % k for k in range(len(fps))]
    points = spark.createDataFrame([(bytearray(n), bytearray(fp.tobytes()), sorted(s)) for n, fp, s in zip(names, fps, shards, strict=True)], "node binary, fp binary, shards array<long>")
    roots = {bytes(r["node"]): bytes(r["root"]) for r in components.components(simhash.wide_links(points, reach, cell)).collect()}
    assert classes([roots.get(n, n) for n in names]) == want
    assert len(set(want)) < len(want)


def test_recall_and_precision_by_similarity(spark):
    """Pairs of a text and an edited one: nearly all of 0.8 or more meet, none below 0.5 do."""
    rng = random.Random(9)
    rows, high, low = [], [], []
    for k in range(400):
        base = [f"v{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        other = edited(base, rng.choice([0.005, 0.01, 0.015, 0.02, 0.15, 0.2]), rng)
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, other)]
        s = jaccard(*sets)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        (high if s >= 0.8 else low if s < 0.5 else []).append(k)
    out = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = lambda ks: sum(out[2 * k + 1] == 2 * k for k in ks) / len(ks)
    assert len(high) > 100 and met(high) >= 0.95
    assert len(low) > 50 and met(low) == 0
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {k for k, c in out.items() if k == c}
