import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import toxicity
from siltstone.llm.tokens import Encoder, default_path
from siltstone.runtime import table
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_neardup import kept_by_brute_force
from tests.llm.test_superkmer import brute as cleaned_digests

WORDS = [f"w{k}" for k in range(300)] + ["the", "of", "and"]


@pytest.fixture
def sf_dir(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    shared = text(60)
    rows = []
    for k in range(120):
        t = text(rng.randrange(1, 250))
        if k % 10 == 0:
            t += " stupid idiot moron trash"
        if k % 9 == 1:
            t += " " + shared + " " + text(5)
        rows.append((k, t, "en", f"s{k % 4}"))
    rows += [(500 + k, rows[3 * k + 1][1], "en", "copies") for k in range(10)]
    rows += [(600, None, None, None), (601, "", "en", "s1"), (602, "again", "en", "s2"), (602, "again", "en", "s2"), (None, text(30), "en", None)]
    full = [(k, t, lang, s, None if t is None else len(t)) for k, t, lang, s in rows]
    d = f"file://{tmp_path}"
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def kept_texts(rows):
    """Words outside repeated windows, by the test's own slow rule, per row."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.sha256((rows[k][1] or "").encode()).hexdigest()[:16]))
    seen, out = set(), {}
    for k in order:
        words = (rows[k][1] or "").split()
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(w)
        out[k] = " ".join(w for w, g in zip(words, gone, strict=True) if not g) if any(gone) else rows[k][1]
    return [out[k] for k in range(len(rows))]


def test_run_against_brute_force(spark, sf_dir):
    d, rows = sf_dir
    model = toxicity.train(table(spark, d, "documents"), table(spark, d, "labels"))
    rows = [r for r in rows if model.score((r[1] or "").encode()) < 0.5]
    assert 90 < len(rows) < 125 and not any("moron" in (r[1] or "") for r in rows)
    winners, _ = kept_by_brute_force([r[:2] for r in rows])
    kept = [next(r for r in rows if r[:2] == w) for w in winners]
    texts = kept_texts(kept)
    assert [c[3] for c in cleaned_digests([(r[0], r[1]) for r in kept])] and any(a != b[1] for a, b in zip(texts, kept, strict=True))
    docs = [(r[0], t, r[3]) for r, t in zip(kept, texts, strict=True)]
    encode = Encoder(default_path())
    want = Counter()
    for (k, t, _), (_, size, _, _, taken) in zip(docs, mixed(docs), strict=True):
        if size:  # a blank document's copies can't be told from the words it is taken
            want[k] += taken // size * (len(encode(t)) // 4 + 1)
    got, spans = Counter(), defaultdict(list)
    for r in corpus_pipeline.run(spark, d).collect():
        if any(k == r.doc_id and re.search(r"\S", t or "") for k, t, _ in docs):
            got[r.doc_id] += r.length
        spans[r.sequence_id].append((r.offset, r.length, r.ids))
    assert +want == got
    blank = [(k, t) for k, t, _ in docs if not re.search(r"\S", t or "")]
    assert len(blank) == 1 and max(len(encode(t)) // 4 + 1 for _, t in blank) == 1
    for parts in spans.values():
        at = 0
        for offset, n, ids_ in sorted(parts):
            assert offset == at and n == len(ids_)
            at += n
        assert at == 2048 or at & (at - 1) == 0


def test_stages_keep_the_columns(spark, sf_dir):
    d, _ = sf_dir
    clashing = ("_key", "_RATE", "_copy", "_kept", "_of", "_doc", "_spans", "_last", "_id", "_digest", "fp", "k0", "cid", "y", "size", "target", "rate", "value", "node", "component", "bytes", "grams", "score", "ids", "n")
    docs = table(spark, d, "documents").withColumns({c: F.lit(k) for k, c in enumerate(clashing)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.count() > 0, name
    empty = table(spark, d, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0, name
