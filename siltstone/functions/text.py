"""Scalar text functions as Columns; Arrow functions only where no expression gives the result."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Unicode white space; the redaction patterns, in order, and their mark.
WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SECRET_PATTERNS = (
    r"(?iu)(authorization[\t\n\f\r ]*[:=][\t\n\f\r ]*)([^\t\n\f\r ]+)",
    r"(?iu)((?:api[_-]?key|token|password|secret)[\t\n\f\r ]*=[\t\n\f\r ]*)([^\t\n\f\r ]+)",
    r"(?iu)(://[^:\t\n\f\r ]+:)([^@\t\n\f\r ]+)(@)",
)
REDACTED = "[REDACTED]"
SENSITIVE_KEYS = ("apiKey", "api_key", "authorization", "cookie", "password", "secret", "token", "access_token", "refresh_token", "private_key")
TOOL_SUFFIX = "\n...[tool output truncated by harness]"
SKILL_SUFFIX = "\n...[skill content truncated by harness]"
COMMAND_SUFFIX = "\n...[command output truncated by harness]"
SLUG_BYTES = 64
#: What tool arguments may have in bytes.
ARGUMENT_BYTES = 65536
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_unicode(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), f"^[{WHITE}]+|[{WHITE}]+$", "")


def is_blank(c: str | Column) -> Column:
    """Whether trimming leaves nothing; it is seen at the first other character, however long the text is."""
    return ~_col(c).rlike(f"[^{WHITE}]")


def preview(c: str | Column, n: int) -> Column:
    """The first n characters, and dots if any are left."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def truncate_bytes(c: str | Column, most: int, suffix: str = TOOL_SUFFIX) -> Column:
    """As binary: at most `most` bytes, the suffix counted; most <= 0 leaves all. A code point may be split."""
    data, tail = _col(c).cast("binary"), suffix.encode()
    if most <= 0:
        return data
    cut = F.lit(tail[:most]) if most <= len(tail) else F.concat(F.substring(data, 1, most - len(tail)), F.lit(tail))
    return F.when(F.octet_length(data) <= most, data).otherwise(cut)


def truncate_then_mark(c: str | Column, most: int, suffix: str = SKILL_SUFFIX) -> Column:
    """As binary: `most` bytes, then the suffix, which isn't counted."""
    data = _col(c).cast("binary")
    return F.when(F.octet_length(data) <= most, data).otherwise(F.concat(F.substring(data, 1, most), F.lit(suffix.encode())))


def limited_output(c: str | Column, most: int) -> tuple[Column, Column]:
    """The first `most` bytes, and whether any were cut."""
    data = _col(c).cast("binary")
    return F.substring(data, 1, most), F.octet_length(data) > most


def fits(c: str | Column, most: int) -> Column:
    return F.octet_length(_col(c)) <= most


def redact(c: str | Column) -> Column:
    out = _col(c)
    for pattern in SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, f"$1{REDACTED}")
    return out


def slugify(c: str | Column) -> Column:
    """Letters and digits in lower case, a hyphen for each run of others, cut at SLUG_BYTES bytes; 'document' if nothing is left."""
    # What follows more letters and digits than the slug has bytes can't be in it; a few more keep the case rules' context.
    ahead = F.regexp_extract(_col(c), r"^(?:[^\p{L}\p{Nd}]*+[\p{L}\p{Nd}]){0,%d}+" % (SLUG_BYTES + 16), 0)
    raw = F.regexp_replace(F.lower(ahead), r"[^\p{L}\p{Nd}]+", "-")
    raw = F.regexp_replace(raw, "^-+", "")
    # The cut falls after the character that reaches the limit; bytes are counted only for the texts that need it.
    short = F.when(F.octet_length(raw) <= SLUG_BYTES, raw).otherwise(_cut_slug(raw))
    slug = F.regexp_replace(short, "^-+|-+$", "")
    return F.when(slug == "", F.lit("document")).otherwise(slug)


def _cut_slug(c: Column) -> Column:
    """Without a UDF: the longest prefix of characters that begin before the limit."""
    chars = F.split(F.left(c, F.lit(SLUG_BYTES)), "")
    folded = F.aggregate(
        chars, F.lit(""), lambda acc, x: F.when(F.octet_length(acc) < SLUG_BYTES, F.concat(acc, x)).otherwise(acc)
    )
    return folded


def metadata_string(metadata: str | Column, key: str) -> Column:
    """A string member of JSON metadata, '' if missing or of another type."""
    value = F.try_variant_get(F.try_parse_json(_col(metadata)), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.coalesce(F.try_variant_get(F.try_parse_json(_col(metadata)), f"$.{key}", "string"), F.lit(""))).otherwise(F.lit(""))


def metadata_int(metadata: str | Column, key: str) -> Column:
    """An integer or numeric-string member of JSON metadata, else 0."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(_col(metadata)), f"$.{key}", "string").try_cast("int"), F.lit(0))


class _Number(str):
    """A JSON number as it was written."""


def _key(name: str) -> str:
    return name.lower().replace("-", "").replace("_", "").strip(_SPACES)


_SENSITIVE = frozenset(map(_key, SENSITIVE_KEYS))
_SCRUBBED = [re.compile(pattern.replace("(?iu)", "(?i)")) for pattern in SECRET_PATTERNS]


def _scrub(value, keys: frozenset):
    if isinstance(value, dict):
        return {k: REDACTED if _key(k) in keys else _scrub(v, keys) for k, v in value.items()}
    if isinstance(value, list):
        return [_scrub(v, keys) for v in value]
    if isinstance(value, str) and not isinstance(value, _Number):
        for pattern in _SCRUBBED:
            value = pattern.sub(lambda m: m.group(1) + REDACTED, value)
    return value


def _written(value) -> str:
    """Keys in order, no spaces, numbers as they came; <, >, & and line separators escaped."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_written(k)}:{_written(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    if isinstance(value, _Number):
        return str(value)
    return re.sub("[<>&\u2028\u2029]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))


def _decoded(text: str, alone: bool = False):
    """The JSON value that text begins with; alone: nothing but another JSON value may follow."""
    decoder = json.JSONDecoder(parse_int=_Number, parse_float=_Number)
    text = text.strip(_SPACES)
    value, end = decoder.raw_decode(text)
    if alone and text[end:].strip(_SPACES):
        decoder.raw_decode(text[end:].strip(_SPACES))
    return value


def _canonical(text: str, shown: bool) -> str | None:
    try:
        value = _decoded(text)
    except ValueError:
        return None
    return _written(_scrub(value, _SENSITIVE) if shown else value)


def _each(texts: pa.Array, shown: bool) -> pa.Array:
    return pa.array([None if t is None else _canonical(t, shown) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def canonical_json(texts: pa.Array) -> pa.Array:
    """Canonical form; null for what isn't JSON. Exact numbers rule out VARIANT here."""
    return _each(texts, False)


@F.arrow_udf(StringType())
def redacted_json(texts: pa.Array) -> pa.Array:
    """Canonical form with sensitive members and secrets in strings replaced."""
    return _each(texts, True)


_PREPARED = "struct<arguments_hash: string, display_arguments: string, error: string>"


def _prepared(text: str | None, most: int) -> dict:
    if text is None or len(text.encode()) > most:
        return {"error": "no arguments" if text is None else f"over {most} bytes"}
    try:
        value = _decoded(text, alone=True)
    except ValueError:
        return {"error": "not a JSON value"}
    return {"arguments_hash": hashlib.sha256(_written(value).encode()).hexdigest(), "display_arguments": _written(_scrub(value, _SENSITIVE))}


def prepared_arguments(c: str | Column, most: int = ARGUMENT_BYTES) -> Column:
    """Tool arguments as a struct: the canonical form's SHA-256 and the redacted form, from one decoding; or else why they are refused."""
    if most <= 0:
        raise ValueError("most must be greater than 0")
    kind = pa.struct([(n, pa.string()) for n in ("arguments_hash", "display_arguments", "error")])

    @F.arrow_udf(_PREPARED)
    def prepared(texts: pa.Array) -> pa.Array:
        return pa.array([_prepared(t, most) for t in texts.to_pylist()], kind)

    return prepared(_col(c))


def fingerprint(c: str | Column) -> Column:
    """SHA-256 of the canonical form, before redaction."""
    return F.sha2(canonical_json(_col(c)), 256)


def new_uuid() -> Column:
    """A random UUID (version 4) for each row; another one when the row is computed again, so write it before it is used."""
    return F.expr("uuid()")


def is_skill_name(c: str | Column) -> Column:
    """ASCII letters, digits, hyphens and underscores, at least one; null is no name."""
    return F.coalesce(_col(c).rlike(r"\A[A-Za-z0-9_-]+\z"), F.lit(False))


def is_host_port(c: str | Column) -> Column:
    """host:port after trimming: no white space within, a host (in brackets if it has colons), a port from 1 to 65535."""
    trimmed = trim_unicode(c)
    port = F.regexp_extract(trimmed, r"\A(?:\[[^\[\]\s]+\]|[^:\[\]\s]+):(\+?[0-9]+)\z", 1)
    return F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False))


def base36(c: str | Column) -> Column:
    return F.lower(F.conv(_col(c).cast("string"), 10, 36))
