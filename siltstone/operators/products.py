"""Product files: front matter between '---' lines, Markdown after it, many products a file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import _SPACES

# The front matter's fields.
TEXT_FIELDS = ("product_id", "model", "family_prefix", "series_name", "product_name", "category_l1", "category_l2", "source_doc")
SPEC_TEXT = ("mechanics_type", "install_type", "adjust_type", "door_material", "base_material", "surface_finish")
SPEC_INT = ("open_angle_deg", "cup_diameter_mm", "door_thickness_min_mm", "door_thickness_max_mm")
DELIMITER = "---"

SCHEMA = (
    ", ".join(f"{f} string" for f in TEXT_FIELDS)
    + ", specs_from_doc struct<" + ", ".join([f"{f}: string" for f in SPEC_TEXT] + [f"{f}: int" for f in SPEC_INT]) + ">, variants array<string>, content string, _source string"
)


def blocks(text: str) -> list[tuple[str, str]]:
    """(front matter, body) of each product. Delimiter lines open and close by turns; what precedes the first is dropped."""
    lines = text.lstrip("\ufeff" + _SPACES).split("\n")
    marks = [k for k, line in enumerate(lines) if line.strip(_SPACES) == DELIMITER]
    if len(marks) % 2:
        raise ValueError("a product's front matter isn't closed")
    out = []
    for k in range(0, len(marks), 2):
        end = marks[k + 2] if k + 2 < len(marks) else len(lines)
        out.append(("\n".join(lines[marks[k] + 1 : marks[k + 1]]), "\n".join(lines[marks[k + 1] + 1 : end]).strip(_SPACES)))
    return out


def _value(node):
    """A YAML node as text, None, a list or a dict; scalars keep the form they are written in."""
    import yaml

    if isinstance(node, yaml.MappingNode):
        out = {}
        for key, value in node.value:
            if key.value in out:
                raise ValueError(f"{key.value!r} is there twice")
            out[key.value] = _value(value)
        return out
    if isinstance(node, yaml.SequenceNode):
        return [_value(x) for x in node.value]
    return None if node.tag == "tag:yaml.org,2002:null" else node.value


def front_matter(text: str) -> dict:
    """YAML's mapping; no text is an empty one."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("product files are read with PyYAML") from e
    try:
        node = yaml.compose(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError as e:
        raise ValueError(f"bad front matter: {e}") from e
    if node is None:
        return {}
    if not isinstance(node, yaml.MappingNode):
        raise ValueError("front matter isn't a mapping")
    return _value(node)


def _text(fields: dict, name: str) -> str | None:
    if isinstance(fields.get(name), list | dict):
        raise ValueError(f"{name} isn't a text")
    return fields.get(name)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    specs = pa.struct([(f, pa.string()) for f in SPEC_TEXT] + [(f, pa.int32()) for f in SPEC_INT])
    schema = pa.schema([(f, pa.string()) for f in TEXT_FIELDS] + [("specs_from_doc", specs), ("variants", pa.list_(pa.string())), ("content", pa.string()), ("_source", pa.string())])
    for batch in batches:
        rows = []
        for source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for head, body in blocks(text or ""):
                fields = front_matter(head)
                spec = fields.get("specs_from_doc") or {}
                rows.append(
                    {f: _text(fields, f) for f in TEXT_FIELDS}
                    | {"specs_from_doc": {f: _text(spec, f) for f in SPEC_TEXT} | {f: None if spec.get(f) is None else int(_text(spec, f)) for f in SPEC_INT}}
                    | {"variants": fields.get("variants") or [], "content": body, "_source": source}
                )
        yield pa.RecordBatch.from_pylist(rows, schema)


def parse_products(files: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """A row per product of files (source, text)."""
    return files.select(F.col(source).cast("string"), F.col(text).cast("string")).mapInArrow(_parsed, SCHEMA)


def overlay(metadata, extra):
    """A metadata map with a caller's entries over it."""
    return F.map_concat(F.map_filter(metadata, lambda k, _: ~F.array_contains(F.map_keys(extra), k)), extra)
