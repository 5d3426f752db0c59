import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.functions.text import _SPACES
from siltstone.operators import chunking, products

LINES = st.lists(st.sampled_from(["# A", "## B c", "### ", "#x", "#", "####### h", "```", "~~~ py", "text.", "", "  # in", "more text! 好。", "# D\r"]), max_size=14).map("\n".join)


def test_sections():
    assert chunking.sections("# A\nx\n### C\ny\n~~~\n# not\n~~~\n## B\nz") == [("A", "x\n"), ("A >  > C", "y\n~~~\n# not\n~~~\n"), ("A > B", "z\n")]
    assert chunking.sections("# H") == [("", "# H")]
    assert chunking.sections("before\n# H\nafter") == [("", "before\n"), ("H", "after\n")]
    assert chunking.sections("#x\n#\n####### h") == [("", "#x\n#\n####### h\n")]
    assert list(chunking.pieces("# A\nx", 1200)) == [("A", "# A\n\nx")]
    assert list(chunking.pieces(" \n ", 1200)) == list(chunking.pieces(None, 1200)) == []


@pytest.mark.parametrize(("text", "most", "want"), [
    ("ab.cdefgh.\n", 6, ["ab.cde", "efgh.\n"]),
    ("abcdefghijklm\n", 6, ["abcdef", "fghijk", "klm\n"]),
    ("aaaaaaaaaaaa\n", 12, ["aaaaaaaaaaaa\n", "a\n"]),
    ("abcdefghijk.\n", 12, ["abcdefghijk.\n", ".\n"]),
    ("abcdefghijkl.xyz\n", 12, ["abcdefghijkl.", "l.xyz\n"]),
])
def test_windows(text, most, want):
    assert chunking.windows(text, most) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .。\n!é", max_size=300), st.integers(4, 60))
def test_windows_cover_the_text(text, most):
    pieces = chunking.windows(text, most)
    assert max(map(len, pieces)) <= most + 1
    at, covered = 0, 0
    for piece in pieces:
        at = text.index(piece, max(0, at))
        assert text[at : at + len(piece)] == piece and at <= covered
        covered = max(covered, at + len(piece))
        at = max(at + len(piece) - most // 6, at + 1)
    assert covered == len(text)


def test_sections_by_lines_agree(spark):
    found = []

    @settings(max_examples=150, deadline=None, database=None)
    @given(LINES)
    def collect(text):
        found.append(text)

    collect()
    rows = list(enumerate(found))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = chunking.sections_by_lines(df).collect()
    split = chunking.split_sections(df).collect()
    assert sorted((r.doc_id, r.heading_path, r.text) for r in split) == sorted((k, *s) for k, t in rows for s in chunking.sections(t))
    want = [(k, path, text) for k, t in rows for path, text in chunking.sections(t) if text.strip(_SPACES)]
    assert sorted((r.doc_id, r.heading_path, r.text) for r in got) == sorted(want)


def test_chunk_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "# A\nx", "k"), (2, None, "l")], "doc_id long, text string, other string")
    assert [tuple(r) for r in chunking.chunk(df).collect()] == [(1, "k", 0, "A", "# A\n\nx")]


def test_products(spark):
    text = "junk\n---\nproduct_id: P1\nmodel: M1\nspecs_from_doc:\n  open_angle_deg: 110\nvariants: [a, b]\n---\n# T1\nbody\n---\nproduct_id: P2\n---\nb2"
    rows = products.parse_products(spark.createDataFrame([("f", text), ("none", "no marks"), ("null", None)], "source string, text string")).collect()
    assert [(r.product_id, r.model, r.content, r._source) for r in rows] == [("P1", "M1", "# T1\nbody", "f"), ("P2", None, "b2", "f")]
    assert rows[0].specs_from_doc.open_angle_deg == 110 and rows[0].variants == ["a", "b"] and rows[1].specs_from_doc.open_angle_deg is None
    with pytest.raises(ValueError):
        products.blocks("---\nproduct_id: P1\n")
    head = """product_id: "a # b"
model: 'it''s' # brand
series_name: "say \\"hi\\""
variants: ["a, b", c, 'd']
family_prefix: |
  two
  lines
category_l1: >-
  one
  line
category_l2: ~
product_name: "null"
specs_from_doc: {install_type: x, open_angle_deg: 110}
"""
    got = products.front_matter(head)
    assert got == {"product_id": "a # b", "model": "it's", "series_name": 'say "hi"', "variants": ["a, b", "c", "d"], "family_prefix": "two\nlines\n", "category_l1": "one line", "category_l2": None, "product_name": "null", "specs_from_doc": {"install_type": "x", "open_angle_deg": "110"}}
    assert products.front_matter("") == {} == products.front_matter("# only a comment")
    for bad in ("a: [", "- list", "a: 1\na: 2", "just text", "a: b: c"):
        with pytest.raises(ValueError):
            products.front_matter(bad)
    from pyspark.sql import functions as F

    m = spark.sql("SELECT map('a', '1', 'b', '2') AS m, map('b', '3') AS e").select(products.overlay(F.col("m"), F.col("e")).alias("x")).first().x
    assert m == {"a": "1", "b": "3"}
