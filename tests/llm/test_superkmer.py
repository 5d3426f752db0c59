import hashlib
import os
import random
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from siltstone.llm import superkmer


def brute(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.sha256((rows[k][1] or "").encode()).hexdigest()[:16]))
    seen, out = set(), {}
    done = {}
    for k in order:
        if rows[k] in done:
            out[k] = done[rows[k]]
            continue
        words = (rows[k][1] or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - superkmer.WINDOW + 1):
            w = tuple(words[i : i + superkmer.WINDOW])
            if w in seen:
                gone[i : i + superkmer.WINDOW] = [True] * superkmer.WINDOW
            seen.add(w)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[k] = done[rows[k]] = (rows[k][0], len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out.values()


@pytest.fixture
def rows():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    text = lambda n: " ".join(word() for _ in range(n))
    shared, copy = text(45), text(300)
    out = [(k, text(rng.randrange(0, 200))) for k in range(60)]
    out += [(100 + k, f"{text(rng.randrange(30))}\n{shared} {text(40)}") for k in range(60)]
    out += [(300 + k, copy) for k in range(40)]
    out += [(400 + k, copy.replace("w7", f"z{k}")) for k in range(30)]
    out += [(500, "a " * 500), (501, None), (502, ""), (503, " \t\n"), (504, "short text"), (505, shared + " tail"), (None, text(30)), (-4, copy)]
    out += [(600, text(20000)), (601, "é " * 25 + shared), (2, out[2][1]), (700, out[70][1]), (700, out[70][1])]
    return out


def test_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(repr, map(tuple, superkmer.digest(df).collect())))
    assert got == sorted(map(repr, brute(rows)))


def test_heavy_bins_change_nothing(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(superkmer, "plan", lambda docs: (np.arange(4096) % 2 == 0, 7))
    got = sorted(map(repr, map(tuple, superkmer.digest(df).collect())))
    assert got == sorted(map(repr, brute(rows)))


def test_plan_finds_heavy_bins_at_any_size(spark, rows, monkeypatch):
    df = spark.createDataFrame([(k, "common words of all documents " * 8 + t if t else t) for k, t in rows], "doc_id long, text string")
    want = sorted(map(repr, brute([tuple(r) for r in df.collect()])))
    for bucket, least, most in ((1 << 18, 1 << 12, 1 << 20), (64, 16, 1 << 20), (64, 16, 16)):
        monkeypatch.setattr(superkmer, "BUCKET_WORDS", bucket)
        monkeypatch.setattr(superkmer, "BINS_LEAST", least)
        monkeypatch.setattr(superkmer, "BINS_MOST", most)
        heavy, buckets = superkmer.plan(df)
        assert len(heavy) & (len(heavy) - 1) == 0 and least <= len(heavy) <= most
        assert (buckets > 100 and heavy.any() and not heavy.all()) if bucket == 64 and most > 16 else True
        assert sorted(map(repr, map(tuple, superkmer.digest(df.repartition(3)).collect()))) == want


def test_long_words_travel_as_digests(spark, monkeypatch):
    monkeypatch.setattr(superkmer, "LONGEST_WORD", 12)
    long = ["x" * 40, "y" * 40, "x" * 39]
    body = lambda w: " ".join(["a", w, *[f"w{k}" for k in range(30)]])
    rows = [(k, body(long[k % 3])) for k in range(9)] + [(20, "plain " * 30), (21, "z" * 500)]
    got = sorted(map(repr, map(tuple, superkmer.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())))
    assert got == sorted(map(repr, brute(rows)))


def test_one_giant_word_fits_in_memory():
    """A blank-free text of 64 MB through every step of a worker: what it adds stays below 600 MB."""
    code = """
import resource, pyarrow as pa, numpy as np
from siltstone.llm import superkmer as s
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
began = peak()
text = b"q" * (64 << 20)
batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array([b"d" * 17]), pa.array([text])], ["doc", "text"])])
list(s._counted((b.select(["text"]) for b in batch()), 4096))
sent = list(s._sent(batch(), np.zeros(4096, bool), 5))
list(s._judged(iter(sent)))
assert s.kept_words(text, None)[1] == 1
print((peak() - began) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(out.stdout) < 600


def test_oracle_equals_brute_force():
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    assert sorted(con.sql(superkmer.ORACLE).fetchall()) == sorted(brute(rows))


def test_empty_and_clashing_columns(spark, rows):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert superkmer.digest(empty).count() == 0
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], "doc_id long, text string, doc string, spans int, key int")
    out = superkmer.remove_repeats(df)
    assert out.schema == df.schema and out.count() == len(rows)
