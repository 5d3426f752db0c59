import random

import numpy as np
import pytest
import xxhash

from corpus_pipeline import _near_duplicates
from siltstone.llm import similar, simhash


def grams(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_brute_force(rows):
    """Of rows (doc_id, text), the kept ones of each group linked by Jaccard of 0.8 or more, and how many groups have links."""
    sets = [grams(t) for _, t in rows]
    label, linked = list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                linked += sets[a] != sets[b]
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    best = {}
    for (k, t), r in zip(rows, label, strict=True):
        digest = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
        mine = (k is None, k or 0, digest - (digest >> 63 << 64), (k, t))
        best[r] = min(best.get(r, mine), mine)
    return [w[-1] for w in best.values()], linked


def corpus():
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for k in range(60):
        base = text(rng.randrange(40, 200))
        rows.append(" ".join(base))
        edited = list(base)
        for _ in range(rng.randrange(0, 6)):
            edited[rng.randrange(len(edited))] = "changed"
        rows.append(" ".join(edited))
    hub = text(150)
    rows.append(" ".join(hub))
    for _ in range(40):  # far from each other, near through the hub
        edited = list(hub)
        for at in rng.sample(range(150), 3):
            edited[at] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(edited))
    passage = text(60)
    rows += [" ".join(text(90) + passage) for _ in range(40)]  # a common passage, no near copies
    rows += ["short text", "Short  text", "other text", "", " ", "ÄÖ\x0bword " * 30000, "one " * 5000]
    rows = [(3 * k, t) for k, t in enumerate(rows)]
    rows += [(9000, None), (9001, rows[0][1]), (None, rows[4][1].upper()), (None, "lonely words"), (None, "lonely words"), (6, rows[2][1]), (7, "seventh"), (7, "seventh"), (7, "Seventh day")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_stage_keeps_one_of_each_group_at_four_fifths(spark, monkeypatch, small):
    if small:  # many tiles, many blocks, and joins by shuffle
        monkeypatch.setattr(simhash, "TILE_LEAST", 8)
        monkeypatch.setattr(simhash, "TILES_AIMED", 1000)
        monkeypatch.setattr(similar, "BLOCK_TEXTS", 7)
        monkeypatch.setattr(similar, "SPLIT_TEXTS", 3)
        monkeypatch.setattr(similar, "HUB_TEXTS", 4)
        monkeypatch.setattr(similar, "BROADCAST_ROWS", 0)
    rows = corpus()
    want, linked = kept_by_brute_force(rows)
    assert linked > 60 and 90 < len(want) < 180
    df = spark.createDataFrame([(*r, 1, "a", 2, 3) for r in rows], "doc_id long, text string, _id int, FP0 string, k0 int, value int").repartition(3)
    kept = _near_duplicates(spark, df, "")
    assert kept.schema == df.schema
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))


SIZES = [("sf0.001", 1), ("sf0.01", 1), ("sf0.01", 30)]


@pytest.mark.parametrize(("sf", "times"), SIZES)
def test_recall_and_chance_links_at_three_sizes(sf, times):
    """All similar pairs are candidates, and hardly any unlike ones, whatever the size.

    A table is made larger by further versions of its texts, all their words renamed, so that no pair of
    two versions is alike but texts have the lengths and repeats of the table.
    """
    import pyarrow.parquet as pq

    texts = sorted(set(pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()) - {None})
    base = [similar.shingle_set(t.encode()) for t in texts]
    sets = base + [similar._lane(np.sort(s), k) for k in range(times - 1) for s in base]  # renamed words: other hashes, as many
    prints, n = np.stack([similar.sketch(np.sort(s)) for s in sets]), np.array([len(s) for s in sets])
    found = set()
    for i, j in similar.pairs(prints, n, None, n, similar.RADIUS, similar.SIMILARITY):
        found |= set(zip(i.tolist(), j.tolist(), strict=True))
    holders = {}
    for k, s in enumerate(base):
        for v in s.tolist():
            holders.setdefault(v, []).append(k)
    common = {}
    for held in holders.values():
        for x, a in enumerate(held):
            for b in held[x + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    alike = {(a, b) for (a, b), c in common.items() if 10 * c >= 8 * (n[a] + n[b] - c)}
    assert len(alike & found) >= 0.9 * len(alike) and (alike or sf != "sf0.01")

    def jaccard(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return both / max(1, n[a] + n[b] - both)

    unlike = sum(jaccard(a, b) < 0.5 for a, b in found)
    assert unlike <= 0.0005 * len(sets) and sum(a // len(base) != b // len(base) for a, b in found) <= 0.0001 * len(sets)


def test_a_dense_group_is_done_by_its_hub(spark, monkeypatch):
    """Near copies of one text, more than meet one copy of it, need no comparison of blocks."""
    monkeypatch.setattr(similar, "HUB_TEXTS", 20)
    monkeypatch.setattr(similar, "_in_blocks", None)
    rng = random.Random(8)
    hub = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(hub))]
    for k in range(1, 150):
        edited = list(hub)
        edited[rng.randrange(300)] = f"x{k}"
        rows.append((k, " ".join(edited)))
    kept = similar.keep_one(spark.createDataFrame(rows + [(500, "something else")], "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 500]
