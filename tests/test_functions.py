import pytest
from pyspark.sql import functions as F

from siltstone.functions import policy, text, vector


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_redact(spark):
    cases = {
        "password = hunter2 ok": "password = [REDACTED] ok",
        "Authorization: Bearer abc": "Authorization: [REDACTED] abc",
        "db://u:p@host/x": "db://u:[REDACTED]host/x",
        "API-KEY=abc token=x": "API-KEY=[REDACTED] token=[REDACTED]",
        "the secret: abc": "the secret: abc",
    }
    assert values(spark, cases, text.redact("x")) == list(cases.values())
    once = values(spark, cases, text.redact("x"))
    assert values(spark, once, text.redact("x"))[0] == once[0]


def test_slug(spark):
    cases = {"../../../etc/passwd": "etc-passwd", " A  B!! 安装": "a-b-安装", "***": "document", "": "document", "é" * 100: "é" * 32, "ab " * 40: ("ab-" * 21 + "a"), "安" * 30: "安" * 22}
    assert values(spark, cases, text.slugify("x")) == list(cases.values())


def test_truncation(spark):
    x = "x" * 200
    assert values(spark, [x], text.truncate_bytes("x", 0)) == [x.encode()]
    assert bytes(values(spark, [x], text.truncate_bytes("x", 20))[0]) == b"\n...[tool output tru"
    assert bytes(values(spark, [x], text.truncate_bytes("x", 100))[0]) == b"x" * 62 + text.TOOL_SUFFIX.encode()
    assert bytes(values(spark, ["é"], text.truncate_then_mark("x", 1, "!"))[0]) == "é".encode()[:1] + b"!"
    assert values(spark, ["1234", "12345", "éé", "ééa"], text.fits("x", 4)) == [True, False, True, False]
    assert values(spark, ["abc", "abcd", None], text.preview("x", 3)) == ["abc", "abc...", None]
    assert values(spark, ["　a b \n", "\x1cq\x1c"], text.trim_unicode("x")) == ["a b", "\x1cq\x1c"]


def test_arguments(spark):
    raw = ['{"b":"x","a":1}', '{"a": 1, "b": "x"} trailing', '{"Api-Key":1.50,"n":[1e3,"token=q"]}', "{bad", None]
    assert values(spark, raw, text.canonical_json("x")) == ['{"a":1,"b":"x"}', '{"a":1,"b":"x"}', '{"Api-Key":1.50,"n":[1e3,"token=q"]}', None, None]
    assert values(spark, raw[:1], text.fingerprint("x")) == ["ecf9e98ec0641e23113ff3ce8bdc78d0ddd249886517fd4a7f68cc83d4e65667"]
    assert values(spark, raw[2:3], text.redacted_json("x")) == ['{"Api-Key":"[REDACTED]","n":[1e3,"token=[REDACTED]"]}']


def test_metadata(spark):
    rows = ['{"k": 3, "s": "t"}', '{"k": "4"}', '{"k": "q"}', "{bad", None]
    assert values(spark, rows, text.metadata_int("x", "k")) == [3, 4, 0, 0, 0]
    assert values(spark, rows, text.metadata_string("x", "s")) == ["t", "", "", "", ""]


def test_policy(spark):
    tools = ["read_file", "list_dir", "write_file", "shell", "other"]
    assert values(spark, tools, policy.risk(F.col("x"))) == ["read", "read", "write", "high", ""]
    assert values(spark, tools, policy.needs_approval(F.col("x"), True, False)) == [False, False, False, True, True]
    assert values(spark, tools, policy.needs_approval(F.col("x"), False, True)) == [False, False, True, False, True]
    assert values(spark, tools, policy.allowed(F.col("x"), [])) == [False] * 5
    assert values(spark, ["admin", "user", "approver"], policy.has_role(F.col("x"), ["approver"])) == [True, False, True]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(vector.score("ip", F.col("a"), F.col("b")), vector.score(" ", F.col("a"), F.col("b")), vector.score("L2", F.col("a"), F.col("b"))).first()
    assert got[0] == 4 and abs(got[1] - 0.8) < 1e-12 and abs(got[2] - 2**0.5) < 1e-12
    bad = [[1.0, 2.0], [1.0], [1.0, float("nan")], [1.0, float("-inf")], [1.0, None], None]
    assert values(spark, bad, vector.is_valid(F.col("x"), 2), "x array<double>") == [True] + [False] * 5
    with pytest.raises(ValueError):
        vector.metric("hamming")
    assert vector.ascending("l2") and not vector.ascending(None)


def test_names_addresses_and_uuids(spark):
    names = [("a-B_9", True), ("", False), (".", False), ("..", False), ("a b", False), ("a/b", False), ("é", False), ("a\n", False), (None, False)]
    addresses = [("host:1", True), (" h:65535\n", True), ("[::1]:80", True), ("h:0", False), ("h:65536", False), ("h", False), (":80", False), ("a b:80", False), ("::1:80", False), ("h:x", False), ("", False), (None, False), ("h:99999999999", False)]
    df = spark.createDataFrame([(*n, *a) for n, a in zip(names + [names[0]] * 4, addresses, strict=True)], "n string, n_ok boolean, a string, a_ok boolean")
    for r in df.select("n", "n_ok", text.is_skill_name("n").alias("n_is"), "a", "a_ok", text.is_host_port("a").alias("a_is")).collect():
        assert (r.n_is, r.a_is) == (r.n_ok, r.a_ok), (r.n, r.a)
    assert spark.range(50).select(text.new_uuid().alias("u")).distinct().count() == 50


def test_slug_of_long_texts(spark):
    texts = ["!?" * 100_000 + "Ab c", "x " * 50_000, "ΑΣ" * 40, "é" * 200, "- " * 5, "İ" * 70, "a" * 63 + "ß" + "b" * 90, "日 本" * 60]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(text.slugify("t").alias("s")).collect()

    def slow(t):
        out = []
        for ch in t.lower():
            word = ch.isalpha() or ch.isdecimal()
            if word or (out and out[-1] != "-"):
                out.append(ch if word else "-")
            if len("".join(out).encode()) >= 64:
                break
        return "".join(out).strip("-") or "document"

    assert [r.s for r in rows] == [slow(t) for t in texts]
