import hashlib
import re

import pytest
from pyspark.sql import functions as F

from siltstone.llm import fim


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [
    None, "", "a", " ", "one two\n\nthree", "über 日本 😀😀 naïve\r\n\tend", "with <P> inside", "<M>", "near < P> <S <", "<S", "a<", "x\0y", "\\E\\Q$1", "<p>lower</p>", "long word " * 40_000, "é" * 5000,
]
ROWS = [(k, TEXTS[k % len(TEXTS)]) for k in range(-40, 400)] + [(None, "no id"), (None, None), (7, "again again"), (7, "again again"), (2**62, "large id")]


def test_transform_and_restore_against_brute_force(spark):
    clashing = ("units", "digest", "n", "form", "output", "restored", "_found", "prefix")
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).withColumns({c: F.lit("x") for c in clashing})
    done = fim.transform(df)
    assert done.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [tuple(r) for r in fim.restore(done).collect()]
    want = [(*brute(k, t), t or "") for k, t in ROWS]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_digest_has_hashes_of_both_texts(spark):
    df = spark.createDataFrame(ROWS[:50], "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*(b := brute(k, t))[:5], sha(b[5]), sha(t or "")) for k, t in ROWS[:50]]
    assert sorted(map(tuple, fim.digest(fim.restore(fim.transform(df))).collect()), key=repr) == sorted(want, key=repr)


def test_outputs_of_another_form_are_not_restored(spark):
    rows = [("psm", "<P>a<S>b<M>c", "acb"), ("spm", "<P>a<S>b<M>c", None), ("psm", "a<P>b<S>c<M>d", None), ("psm", "<P>a<S>b", None), ("psm", "<P>a<S>b<M>c<M>", None), ("spm", "<S>b<P>a<M>c", "acb"), ("other", "x", None), (None, "x", None), ("psm", None, None), ("plain", "<P>", "<P>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "form string, output string, want string, restored int")
    out = fim.restore(df)
    assert out.columns == [*df.columns, "_restored"]
    assert all(r.want == r._restored for r in out.collect())


def test_parameters(spark):
    df = spark.createDataFrame([(k, "some words here") for k in range(300)], "doc_id long, text string")
    ours = ("[pre]", "[suf]", "[mid]")
    done = fim.transform(df, seed="other", fim_per_cent=50, spm_per_cent=100, sentinels=ours)
    forms = {r.form: r["count"] for r in done.groupBy("form").count().collect()}
    assert forms.keys() == {"plain", "spm"} and 100 < forms["spm"] < 200
    assert fim.restore(done, ours).where("restored = 'some words here'").count() == 300
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "d"), ("aXa", "b", "c"), ("abc", "b", "d")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.transform(df, sentinels=bad)


def test_no_rows_and_no_python(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    done = fim.digest(fim.restore(fim.transform(empty)))
    assert done.collect() == []
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan) and plan.count("regexp_extract_all") <= 1
