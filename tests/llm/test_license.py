import random
import re
import time

import numpy as np

from siltstone.llm import license


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def slow_align(t, x, diagonal=0, band=10**9):
    """Local alignment cell by cell: (score, matched, first, past-last), by score, matched words, then the first to begin."""
    best, above = (0, 0, 0, 0), {}
    for i in range(len(t)):
        row = {}
        for j in range(max(0, i + diagonal - band), min(len(x), i + diagonal + band + 1)):
            s, m, f = above.get(j - 1, (0, 0, -j))
            ways = [(s + 2, m + 1, f) if t[i] == x[j] else (s - 1, m, f)]
            ways += [(s - 1, m, f) for s, m, f in (c for c in (above.get(j), row.get(j - 1)) if c)]
            if max(ways)[0] > 0:
                row[j] = max(ways)
                if row[j] > (best[0], best[1], -best[2]):
                    best = (row[j][0], row[j][1], -row[j][2], j + 1)
        above = row
    return best


def brute(text, templates):
    """Every template aligned with the whole text, with no band or index."""
    found = []
    h = words(text)
    for name in sorted(templates):
        t = words(templates[name])
        rest = [(0, h)]
        while rest:
            at, part = rest.pop()
            score, matched, first, last = slow_align(t, part)
            if part and matched >= license.COVERAGE * len(t):
                found.append((name, matched / len(t), matched, at + first, at + last))
                rest += [(at, part[:first]), (at + last, part[last:])]
    found.sort(key=lambda m: (-m[2], -m[1], m[0], m[3]))
    kept = []
    for m in found:
        if all(m[4] <= k[3] or m[3] >= k[4] for k in kept):
            kept.append(m)
    return sorted((name, round(c, 9), n) for name, c, n, *_ in kept)


def test_align_against_a_slow_version():
    rng = random.Random(3)
    for _ in range(300):
        t = [rng.randrange(rng.choice([2, 6, 30])) for _ in range(rng.randrange(1, 25))]
        x = [rng.randrange(6) for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.7:
            at = rng.randrange(len(x) + 1)
            x = x[:at] + [w for w in t if rng.random() < 0.9] + x[at:]
        band = rng.randrange(1, 8)
        diagonals = [rng.randrange(-len(t), len(x) + 1) for _ in range(4)]
        got = license.align(np.array(t, np.uint64), np.array(x, np.uint64), np.array(diagonals), band).tolist()
        for d, row in zip(diagonals, got, strict=True):
            want = slow_align(t, x, d, band)
            assert row[:3] == list(want[:3]) if want[0] else not any(row)
            assert not want[0] or row[3] <= want[3] + 2 * band


def test_changed_short_notices_and_whole_texts_are_found(spark):
    t = license.TEMPLATES
    rows = [(1, "Released under the terms of the MIT License."), (3, "Released, under the MIT (Expat) License")]
    rows += [(10 + k, "Copyright 2020 A. Person\n" + t[name].replace("copyright holder", "author")) for k, name in enumerate(("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib"))]
    got = {r.doc_id: r.license for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT notice", 3: "MIT notice", 10: "MIT", 11: "BSD-2-Clause", 12: "BSD-3-Clause", 13: "ISC", 14: "Zlib"}


def test_long_texts_made_to_be_slow(spark):
    text = "under the License as published by the Free Software " * 10_000
    began = time.perf_counter()
    license.scan(spark.createDataFrame([(1, text), (2, "q" * (1 << 24))], "doc_id long, text string")).collect()
    assert time.perf_counter() - began < 60


def test_scan_against_brute_force(spark):
    rng = random.Random(6)
    noise = lambda n: " ".join(rng.choice(["the", "License", "under", "of", "and", "naïve", "x1", "version"]) for _ in range(n))
    rows = [(k, noise(rng.randrange(50))) for k in range(30)]
    for k, (name, text) in enumerate(sorted(license.TEMPLATES.items())):
        words = text.split()
        changed = list(words)
        for _ in range(len(words) // 25):
            changed[rng.randrange(len(changed))] = "changed"
        rows.append((100 + k, f"{noise(30)}\n{text.upper()}.\n{noise(20)}"))
        rows.append((200 + k, f"é {noise(12)} // {' '.join(changed)} {noise(9)}"))
        rows.append((300 + k, f"{text} {noise(40)} {text}"))
        rows.append((400 + k, " ".join(words[: len(words) // 2])))
    rows += [(None, "Released under the MIT License."), (900, None), (901, ""), (902, "MIT"), (903, "Released under the MIT License."), (903, "Released under the MIT License.")]
    got = license.scan(spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, license int, coverage string")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.license, round(r.coverage, 9), r.matched_words))
    for k, t in rows:
        want = brute(t or "", license.TEMPLATES) * (2 if k == 903 else 1)
        assert sorted(by.get(k, [])) == want, (k, t)
    texts = {k: t for k, t in rows}
    exact = [r for r in got if r.doc_id is not None and 100 <= r.doc_id < 200 and r.coverage == 1]
    assert len(exact) == len(license.TEMPLATES)
    for r in exact:
        span = texts[r.doc_id][r.start_char : r.end_char]
        assert np.array_equal(license.hashed([span.encode()])[1], license.hashed([license.TEMPLATES[r.license].encode()])[1])
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
