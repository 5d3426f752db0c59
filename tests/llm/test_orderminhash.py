import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from siltstone.llm import orderminhash as o


ALL = (1 << 64) - 1
A, B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def mix(h):
    h = (h ^ (h >> 31)) * A & ALL
    h = (h ^ (h >> 29)) * B & ALL
    return h ^ (h >> 32)


def slow_fingerprint(text, functions=None):
    """From the definition, in plain integers: number the k-mers, rank them under each function, hash the least in text order."""
    if not text:
        return [0] * len(functions or o._FACTOR)
    functions = functions or list(zip(o._FACTOR[:, 0].tolist(), o._SHIFT[:, 0].tolist(), strict=True))
    h = [ord(c) + 1 for c in text]
    if len(h) < 8:
        whole = 0
        for p in h:
            whole = mix(whole ^ p)
        kmers = [whole]
    else:
        for span in (1, 2, 4):
            h = [mix((x * A + y * B) & ALL) for x, y in zip(h, h[span:])]
        kmers = h
    seen, numbered = Counter(), []
    for k in kmers:
        high = k >> 24
        numbered.append(mix(((high << 24) + seen[high] * B) & ALL))
        seen[high] += 1
    out = []
    for a, b in functions:
        ranked = sorted(range(len(kmers)), key=lambda k: ((a * (numbered[k] & 0xFFFFFFFF) + b) & 0xFFFFFFFF, k))
        value = 0x5851F42D4C957F2D
        for k in sorted(ranked[:2]):
            value = mix((value * A + kmers[k]) & ALL)
        out.append(value >> 48)
    return out


def test_fingerprint_is_order_minhash(monkeypatch):
    rng = random.Random(2)
    for n in (0, 1, 7, 8, 9, 40, 300, 3000):
        text = "".join(rng.choice("abcde é日 ") for _ in range(n))
        want = slow_fingerprint(text)
        assert o.fingerprint(text).tolist() == want
        with monkeypatch.context() as m:
            m.setattr(o, "_AT_ONCE", 13)
            assert o.fingerprint(text).tolist() == want
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    moved = text[1500:] + text[:1500]
    assert o.likeness(o.fingerprint(text), o.fingerprint(text[:50] + "x" + text[51:])) > 0.85
    assert o.likeness(o.fingerprint(text), o.fingerprint(moved)) < 0.7  # same k-mers, other order
    assert o.likeness(o.fingerprint(text), o.fingerprint(text[::-1])) < 0.1


@pytest.mark.parametrize("length", [60, 150, 400, 2000])
def test_likeness_follows_edit_distance(monkeypatch, length):
    """The functions behave as independent ones: 64 are as far from 2048 as chance has it; and more edits are less alike."""
    rng = random.Random(length)
    more = np.random.default_rng(1).integers(0, 1 << 32, (2, 2048, 1), dtype=np.uint64).astype(np.uint32)
    means, errors, chance, distinct = [], [], [], []
    for edits in (0.02, 0.06, 0.15, 0.4):
        alike = []
        for _ in range(12):
            text = [rng.choice("abcdefghijklmnop qrst") for _ in range(length)]
            other = list(text)
            for at in rng.sample(range(length), max(1, int(edits * length))):
                other[at] = "#"
            a, b = "".join(text), "".join(other)
            few = o.likeness(o.fingerprint(a), o.fingerprint(b))
            distinct.append(len(set(o.fingerprint(a).tolist())))
            with monkeypatch.context() as m:
                m.setattr(o, "SIGNATURES", 2048)
                m.setattr(o, "_FACTOR", more[0] | np.uint32(1))
                m.setattr(o, "_SHIFT", more[1])
                true = o.likeness(o.fingerprint(a), o.fingerprint(b))
            alike.append(few)
            errors.append(abs(few - true))
            chance.append(np.sqrt(2 / np.pi * true * (1 - true) / 64))
        means.append(np.mean(alike))
    assert means == sorted(means, reverse=True) and means[0] > 0.4 and means[-1] < 0.15
    assert np.mean(errors) < 1.35 * np.mean(chance) < 0.06
    assert np.mean(distinct) > 58


def test_hashes_do_not_depend_on_length():
    rng = random.Random(7)
    for base in ("".join(rng.choice("abcdefgh ") for _ in range(4200)), "For " * 1050):
        for cut in (4090, 4100, 3000, 2040):
            assert o.likeness(o.fingerprint(base), o.fingerprint(base[:cut])) > (cut / 4200) ** 2 - 0.25
    short, long = np.arange(50, dtype=np.uint64) << np.uint64(40), np.arange(5000, dtype=np.uint64) << np.uint64(40)
    assert (o._numbered(short) == o._numbered(long)[:50]).all()


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_compare_against_brute_force(spark, partitions):
    rng = random.Random(4)
    rows = [(k * 7, "".join(rng.choice("abc déf") for _ in range(rng.randrange(200)))) for k in range(40)]
    rows += [(14, "again")] * 60 + [(None, "no id"), (500, None), (501, ""), (-3, "x" * 5000), (-4, "very long " * 200_000)]
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    signed = lambda t: 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = []
    for (k, t), (_, f) in zip(order, order[1:] + order[:1], strict=True):
        t, f = t or "", f or ""
        e = t[: len(t) - len(t) // 3] + f[: len(t) // 3]
        a, b = o.fingerprint(t), o.fingerprint(e)
        want.append((k, len(t), digest(e), "".join(f"{x:04x}" for x in a), "".join(f"{x:04x}" for x in b), o.likeness(a, b), o.likeness(a, o.fingerprint(f))))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        got = o.compare(spark.createDataFrame([(k, t, 1, "b", 2) for k, t in rows], "doc_id long, text string, part int, side string, next int"))
        assert got.columns == names
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
        one = o.compare(spark.createDataFrame([(1, "the only row of this table")], "doc_id long, text string")).collect()
        assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 26)]
        assert o.compare(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
