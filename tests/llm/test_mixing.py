import hashlib
import re
from collections import defaultdict

import pytest

from siltstone.llm import mixing


def brute(rows):
    """Targets by the stated loop: share by weight, cap, hand the excess to the rest, until none is above."""
    size = [len(re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "")) for _, t, _ in rows]
    per = defaultdict(int)
    for n, (_, _, s) in zip(size, rows, strict=True):
        per[s] += n
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size)
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * per[s]}
        if not above:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in above:
            target[s] = 2.0 * per[s]
            left -= target[s]
        open_ -= above
    out = []
    for n, (k, _, s) in zip(size, rows, strict=True):
        rate = target[s] / per[s] if per[s] else 0.0
        u = int(hashlib.md5(f"mix-1:{'' if k is None else k}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((k, n, per[s], round(target[s], 6), n * (int(rate) + (u < rate - int(rate)))))
    return out


ROWS = [(k, f"word\x1cone {k}  tail\n" * (k % 9), "abcdefg"[k % 7] * (k % 2 + 1)) for k in range(400)] + [
    (1000, None, "a"), (1001, "", None), (None, "no id here", None), (1002, "x " * 3000, None), (5, "again", "a"), (5, "again", "a"), (7, " \t", "blank only"), (8, "é\xa0b", "日本"),
]


def test_plan_against_brute_force(spark):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in ROWS], "doc_id long, text string, source string, size int, rate double").repartition(4)
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.plan(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(ROWS)))


def test_mix_emits_what_the_plan_takes(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, target int")
    mixed = mixing.mix(df)
    assert mixed.schema == df.schema
    words = sum(len(re.findall(r"[^ \t\n\x0b\x0c\r]+", r.text or "")) for r in mixed.collect())
    assert words == sum(r.taken for r in mixing.plan(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.mix(df).collect())) == sorted(map(repr, mixed.collect()))


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")], [(1, "a b c", None)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.plan(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
