import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from siltstone.llm import filteraudit, leastid

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, labels):
    """Every order, filter by filter and document by document, as stated."""
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    docs = []
    for k, t, s in rows:
        t = t or ""
        words = [w for w in t.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
        fails = set()
        fails |= {"A"} if len(words) < 50 else set()
        fails |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        fails |= {"D"} if any(c in t for c in "#$%&*|") else set()
        fails |= {"E"} if k is not None and k > least[t] else set()
        docs.append((s or "", fails, k in good, k in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own, total = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(here)
                failing = sum(f in d[1] for d in own)
                out[part, "".join(order), step] = [len(left), len(here), failing - len(here), sum(d[1] == {f} for d in own), sum(d[2] for d in here), sum(d[3] for d in here)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(total[order[step - 1]])
    return out


def corpus():
    rng = random.Random(3)
    rows = []
    for k in range(300):
        words = [rng.choice(["alpha", "beta", "Gamma", "DELTA", "eps ilon", "日本"]) + str(rng.randrange(2 if k % 5 == 0 else 400)) for _ in range(rng.choice([3, 49, 50, 80]))]
        rows.append((k, rng.choice([" ", "\n", " \x0b"]).join(words) + rng.choice(["", "", " 50%", " #tag"]), f"s{k % 4}" if k % 3 else "hot"))
    rows += [(1000 + k, rows[7][1], "hot") for k in range(70)] + [(5, rows[7][1], None), (None, rows[7][1], None), (None, "without an id", ""), (None, "without an id", "")]
    rows += [(2000, None, "s1"), (2001, "", "s1"), (2002, "twice", "once"), (2002, "twice", "once"), (2003, "Very LONG text " * 60_000, "s0"), (2004, "\x1c\x85   x", "s2")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(250)] + [(1003, 1, 1), (1003, 0, None), (None, 1, 1), (99_999, 1, 0), (2002, 1, 0)]
    rng.shuffle(rows)
    return rows, labels


@pytest.mark.parametrize("small", [False, True])
def test_audit_against_brute_force(spark, monkeypatch, small):
    if small:  # joins by shuffle
        monkeypatch.setattr(leastid, "BROADCAST_ROWS", 0)
    rows, labels = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(9) for c in ("part", "failed", "digest", "first", "bits", "n")})
    marks = spark.createDataFrame([(*r, 4) for r in labels], "doc_id long, quality int, toxic int, own int")
    got = filteraudit.audit(df.repartition(5), marks).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * len({s or "" for _, _, s in rows})
    for r in got:
        assert [r[c] for c in COLUMNS] == want[r.part, r.filter_order, r.step], r


def test_blocks_of_the_index_add_up():
    """Bitsets of several blocks, with many parts and parts of many rows, against counting rows."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    bits, parts = rng.integers(0, 1 << 5, 5000).astype(np.int32), [f"p{k}" for k in np.minimum(rng.integers(0, 400, 5000), 300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(parts[a : a + 700]), pa.array(bits[a : a + 700])], ["part", "bits"]) for a in range(0, 5000, 700)]
    filteraudit_rows = list(filteraudit._bitmaps(iter([*batches, batches[0].slice(0, 0)]), 5))
    sums = {}
    for out in filteraudit._counted(iter(filteraudit_rows), 3):
        for row in out.to_pylist():
            key = row["part"], row["before"], row["filter"]
            sums[key] = sums.get(key, 0) + np.array([row["kept"], row["removed"], row["good_lost"]])
    for (part, before, f), (kept, removed, good) in sums.items():
        own = bits[[p == part for p in parts]]
        left = own[own & before == 0]
        assert (kept, removed) == ((left >> f & 1 == 0).sum(), (left >> f & 1).sum())
        assert good == ((left >> f & 1) & (left >> 3 & 1)).sum()


def test_small_tables_and_wrong_filters(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    got = filteraudit.audit(one, labels)
    assert got.count() == 600 and got.agg(F.sum("removed")).first()[0] == 120  # short, in every order
    with pytest.raises(ValueError, match="filters"):
        filteraudit.audit(one, labels, {"E": filteraudit.short})


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x"), (3, "c", "x")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = filteraudit.audit(docs, labels, {"W": lambda text, words: b"a" in words})
    assert sorted(tuple(r)[1:] for r in got.collect()) == [("EW", 1, 2, 1, 0, 0, 0, 0, 1), ("EW", 2, 1, 1, 1, 1, 1, 0, 3), ("WE", 1, 1, 2, 0, 1, 1, 0, 3), ("WE", 2, 1, 0, 1, 0, 0, 0, 1)]
