import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import simhash, vecdedup
from siltstone.llm.components import connected_components


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (3, 2), (2, 3)]
    edges += [(-5, 900), (900, 1 << 62)]
    want = dict(zip(nodes := sorted({x for e in edges for x in e}), [nodes[r] for r in roots(len(nodes), [(nodes.index(a), nodes.index(b)) for a, b in edges])], strict=True))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: c for k, c in want.items() if k != c}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile", [16, 2048])
def test_simhash_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE_LEAST", tile)
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "Of", "ÄB", "tion", "x", "y1", "z."]) + str(rng.randrange(60))
    rows = []
    for k in range(60):
        words = [word() for _ in range(rng.randrange(80, 400))]
        rows.append((10 * k + 5, " ".join(words)))
        for c in range(rng.randrange(4)):
            changed = list(words)
            changed[rng.randrange(len(changed))] = "changed"
            rows.append((10 * k + c, "  ".join(changed).upper() if c % 2 else "\n".join(changed)))
    rows += [(7000, None), (7001, ""), (7002, " \x0b"), (7003, "one two three"), (7004, "ONE two\tthree"), (None, "one two three"), (7003, "one two three"), (None, "lonely words of no id"), (None, "other lonely words"), (None, "other lonely words"), (7005, "w " * 30000), (None, "alone here")]
    prints = [slow_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = roots(len(rows), links)
    least = {}
    for (k, _), r in zip(rows, root, strict=True):
        if k is not None:
            least[r] = min(least.get(r, k), k)
    want = [(k, f"{p:016x}", least.get(r)) for (k, _), p, r in zip(rows, prints, root, strict=True)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(3)
    got = [tuple(r) for r in simhash.digest(simhash.near_duplicates(df)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_simhash_links_are_all_found():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = base[:800] ^ (np.uint64(1) << rng.integers(0, 32, 800).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(32, 64, 800).astype(np.uint64))
    u, v = simhash._compare(base[:, None], near[:, None], 4)
    both = np.concatenate([base, near])
    links = [(a, b) for a, b in zip(*np.nonzero(np.bitwise_count(base[:, None] ^ near[None, :]) <= 4), strict=True)]
    want = roots(len(both), [(a, b + len(base)) for a, b in links])
    got = roots(len(both), list(zip(u.tolist(), v.tolist(), strict=True)))
    assert want == got


def test_empty_tables(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert vecdedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("tile", [32, 1024])
def test_vectors_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vecdedup, "TILE_LEAST", tile)
    monkeypatch.setattr(vecdedup, "TILE_MOST", max(tile, 64))
    rng = np.random.default_rng(4)
    rows = []
    for label in (1, 2, None):
        base = rng.normal(size=(60, 24))
        for k, b in enumerate(base):
            rows.append((len(rows), b.tolist(), label))
            for _ in range(k % 3):
                rows.append((len(rows), (b * rng.uniform(0.1, 9) + rng.normal(size=24) * 0.2 * rng.random() * np.linalg.norm(b) / 5).tolist(), label))
        rows += [(len(rows) + c, base[0].tolist(), label) for c in range(5)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 24, 1), (n + 3, [float("nan")] * 24, 1), (n + 4, [float("inf")] + [1.0] * 23, 1), (n + 5, [None] + [1.0] * 23, 1), (n + 6, [1.0] * 3, 1), (n + 7, [2.0] * 3, 1), (n + 8, [1e30] * 24, 2), (n + 9, [1e-30] * 24, 2), (0, rows[0][1], 1)]
    valid = [r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = []
    for ok, r in zip(valid, rows, strict=True):
        x = np.array(r[1], np.float32).astype(float) if ok else None
        unit.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if ok else None)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if valid[a] and valid[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    root = roots(len(rows), links)
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    least = {}
    for r, k in zip(root, rows, strict=True):
        least[r] = min(least.get(r, k[0]), k[0])
    want = [(k[0], d, least[r], k[0] == least[r]) for k, d, r in zip(rows, degree, root, strict=True)]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<float>, label int, n int, cid string").repartition(3)
    assert sorted(map(repr, map(tuple, vecdedup.near_duplicates(df).collect()))) == sorted(map(repr, want))
    assert vecdedup.near_duplicates(df.withColumn("embedding", F.col("embedding").cast("array<double>"))).exceptAll(vecdedup.near_duplicates(df)).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(5)
    a, b = vecdedup.Tile.of(rng.normal(size=(300, 64))), vecdedup.Tile.of(rng.normal(size=(200, 64)) ** 3)
    true = a.unit @ b.unit.T
    least, most = vecdedup.bounds(a, b)
    assert (least <= true).all() and (true <= most).all() and (most - least).max() < 0.1
    for threshold in (0.0, 0.2, 0.5):
        hit, links = np.zeros(true.shape, bool), np.zeros(true.shape, bool)
        for i, j, sure in vecdedup.judged(a, b, threshold):
            hit[i, j] = True
            links[i[sure], j[sure]] = True
        assert hit[true >= threshold].all() and hit.sum() < (true >= threshold - 0.1).sum() and (true[links] >= threshold).all() and links.any()
        for i, j in vecdedup.linked(a, b, threshold):
            assert not links[i, j].any()
            links[i, j] = True
        assert (links == (true >= threshold)).all()
