"""Scalar function queries over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import policy, text
from siltstone.operators.products import overlay, parse_products
from siltstone.plans.chunks import trim_sql
from siltstone.runtime import cut, scratch, table
from siltstone.sources.files import MOST_BYTES, load_products


def _docs(spark, d):
    return table(spark, d, "documents")


def redact_secrets(spark, d):
    shown = F.concat(F.col("text"), F.lit("\nAuthorization: Bearer abc db://u:p@host/x API-KEY=abc"))
    return _docs(spark, d).select("doc_id", F.md5(text.redact(shown)).alias("redacted_md5"), F.length(text.redact(shown)).alias("chars"))


_REDACT = "text || chr(10) || 'Authorization: Bearer abc db://u:p@host/x API-KEY=abc'"
for _p in text.SECRET_PATTERNS:
    _REDACT = "regexp_replace(" + _REDACT + ", '" + _p.replace("(?iu)", "(?i)") + "', '\\1[REDACTED]', 'g')"


def slugify_titles(spark, d):
    return _docs(spark, d).select("doc_id", text.slugify("text").alias("slug"))


def truncate_bytes(spark, d):
    cut = text.truncate_bytes("text", 200)
    first, truncated = text.limited_output("text", 300)
    return _docs(spark, d).select(
        "doc_id", F.lower(F.hex(cut)).alias("tool"), F.octet_length(text.truncate_then_mark("text", 50)).alias("skill_bytes"), F.md5(first).alias("command_md5"),
        truncated.alias("truncated"), text.fits("text", 1000).alias("fits"), text.preview("text", 10).alias("preview"), F.md5(text.trim_unicode("text")).alias("trimmed_md5"),
    )


def json_metadata_get(spark, d):
    return table(spark, d, "events").select("event_id", text.metadata_int("props", "k").alias("k"), text.metadata_string("props", "missing").alias("missing"), text.metadata_string("props", "k").alias("k_text"))


def args_fingerprint(spark, d):
    """Hash and redacted form of {"value": v, "token": id} as tool arguments, written with spaces and in another order."""
    raw = F.format_string('{ "value" : "%s<&>", "token":"t%s", "id": %s.50 }', "event_type", "event_id", "event_id")
    e = table(spark, d, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", text.fingerprint("raw").alias("fingerprint"), text.redacted_json("raw").alias("shown"))


def risk_classify(spark, d):
    tool = F.element_at(F.array(*map(F.lit, [*policy.RISK, "unknown"])), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, d, "events").select("event_id", tool.alias("tool"), "event_type")
    return e.select("event_id", policy.risk(F.col("tool")).alias("risk"), policy.is_known(F.col("tool")).alias("known"), policy.needs_approval(F.col("tool"), True, False).alias("needs_approval"),
                    policy.allowed(F.col("tool"), ["shell", "read_file"]).alias("allowed"), policy.has_role(F.col("event_type"), ["view", "click"]).alias("may"))


def numeric_conversions(spark, d):
    """Vectors narrowed to floats, ids to base 36, epoch milliseconds and RFC 3339."""
    v = table(spark, d, "events")
    return v.select("event_id", text.base36("event_id").alias("b36"), F.unix_millis(F.col("ts").cast("timestamp")).alias("millis"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("rfc3339"), F.col("value").cast("float").cast("double").alias("narrow"))


def _product_texts(spark, d):
    """(f, text): parts as product files, ten to a file."""
    p = table(spark, d, "part")
    one = F.format_string("---\nproduct_id: P%s\nmodel: %s # brand\nproduct_name: '%s'\nspecs_from_doc:\n  install_type: %s\n  open_angle_deg: %s\nvariants:\n  - a%s\n  - b\n---\n# %s\nbody\n", "p_partkey", "p_brand", "p_name", "p_type", "p_size", "p_size", "p_name")
    return p.groupBy(F.floor(F.col("p_partkey") / 10).alias("f")).agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("text"))


def _product_rows(out):
    return out.select("product_id", "model", "product_name", F.col("specs_from_doc.install_type").alias("install_type"), F.col("specs_from_doc.open_angle_deg").alias("angle"),
                      F.array_join("variants", "+").alias("variants"), "content", F.col("specs_from_doc.cup_diameter_mm").isNull().alias("no_cup"))


def product_front_matter(spark, d):
    """Product files parsed back."""
    files = _product_texts(spark, d).select(F.concat(F.lit("f"), "f").alias("source"), F.concat(F.lit("junk\n"), "text").alias("text"))
    return _product_rows(parse_products(files))


def load_product_files(spark, d):
    """Product files in a folder, read and parsed; a file has as many texts as surely stay below the loader's limit."""
    folder = scratch(spark, "products")
    texts = _product_texts(spark, d).select("text")
    longest = texts.agg(F.max(F.octet_length("text"))).first()[0] or 0
    texts.write.option("lineSep", "\n").option("maxRecordsPerFile", max(1, MOST_BYTES // (longest + 1))).text(folder)
    return _product_rows(load_products(spark, folder))


def metadata_overlay(spark, d):
    """Each document's metadata with a caller's entries over it."""
    known = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    extra = F.create_map(F.lit("source"), F.concat(F.lit("own-"), "lang"), F.lit("chars"), F.col("n_chars").cast("string"))
    m = _docs(spark, d).select("doc_id", overlay(known, extra).alias("m"))
    return m.select("doc_id", *[F.col("m")[k].alias(k) for k in ("lang", "source", "chars")], F.size("m").alias("entries"))


def generated_ids(spark, d):
    """Each event gets a UUID: of 36 characters, version 4, none twice."""
    ids = cut(table(spark, d, "events").select(text.new_uuid().alias("id")))
    form = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return ids.agg(F.count("*").alias("n"), F.countDistinct("id").alias("distinct_ids"), F.count_if(F.col("id").rlike(form)).alias("well_formed"))


def name_checks(spark, d):
    """Words of documents as skill names and addresses, some of them good."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.element_at(F.split("c_name", "#"), 1), F.when(F.col("c_custkey") % 3 == 0, " ").when(F.col("c_custkey") % 3 == 1, "_").otherwise("."), "c_nationkey").alias("name"),
                                           F.concat(F.when(F.col("c_custkey") % 4 != 0, "host").otherwise(""), F.when(F.col("c_custkey") % 5 == 0, " x").otherwise(""), F.lit(":"), F.col("c_custkey") * 97 - 97, F.lit(" ")).alias("address"))
    return c.select("c_custkey", text.is_skill_name("name").alias("good_name"), text.is_host_port("address").alias("good_address"))


_SLUG = "regexp_replace(regexp_replace(lower(" + trim_sql("text") + "), '[^\\p{L}\\p{Nd}]+', '-', 'g'), '^-+', '')"

QUERIES = {
    "redact_secrets": redact_secrets, "slugify_titles": slugify_titles, "truncate_bytes": truncate_bytes, "json_metadata_get": json_metadata_get,
    "args_fingerprint": args_fingerprint, "risk_classify": risk_classify, "numeric_conversions": numeric_conversions, "product_front_matter": product_front_matter,
    "generated_ids": generated_ids, "name_checks": name_checks, "metadata_overlay": metadata_overlay, "load_product_files": load_product_files,
}
ORACLES = {
    "redact_secrets": f"SELECT doc_id, md5({_REDACT}) AS redacted_md5, length({_REDACT})::INTEGER AS chars FROM documents",
    "slugify_titles": f"""WITH s AS (SELECT doc_id, {_SLUG} AS raw FROM documents),
      c AS (SELECT doc_id, raw, list_filter(range(1, 66), lambda i: i <= length(raw) AND strlen(left(raw, i - 1)) < 64) AS fit FROM s)
      SELECT doc_id, CASE WHEN slug = '' THEN 'document' ELSE slug END AS slug FROM (SELECT doc_id, regexp_replace(left(raw, len(fit)), '^-+|-+$', '', 'g') AS slug FROM c)""",
    "truncate_bytes": f"""SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN lower(hex(encode(text))) ELSE left(lower(hex(encode(text))), 2 * 162) || lower(hex(encode(chr(10) || '...[tool output truncated by harness]'))) END AS tool,
      (CASE WHEN strlen(text) <= 50 THEN strlen(text) ELSE 50 + 40 END)::INTEGER AS skill_bytes, md5(unhex(left(hex(encode(text)), 600))) AS command_md5, strlen(text) > 300 AS truncated, strlen(text) <= 1000 AS fits,
      CASE WHEN length(text) > 10 THEN left(text, 10) || '...' ELSE text END AS preview, md5({trim_sql('text')}) AS trimmed_md5 FROM documents""",
    "json_metadata_get": "SELECT event_id, coalesce(try_cast(props->>'$.k' AS INTEGER), 0) AS k, '' AS missing, '' AS k_text FROM events",
    "args_fingerprint": """SELECT event_id, sha256('{"id":' || event_id || '.50,"token":"t' || event_id || '","value":"' || event_type || '\\u003c\\u0026\\u003e"}') AS fingerprint,
      '{"id":' || event_id || '.50,"token":"[REDACTED]","value":"' || event_type || '\\u003c\\u0026\\u003e"}' AS shown FROM events""",
    "risk_classify": """SELECT event_id, ['read', 'read', 'write', 'high', ''][event_id % 5 + 1] AS risk, event_id % 5 < 4 AS known, event_id % 5 >= 3 AS needs_approval, event_id % 5 IN (0, 3) AS allowed,
      event_type IN ('admin', 'view', 'click') AS may FROM events""",
    "numeric_conversions": """WITH RECURSIVE b AS (SELECT event_id, event_id AS n, '' AS s FROM events UNION ALL SELECT event_id, n // 36, substring('0123456789abcdefghijklmnopqrstuvwxyz', (n % 36 + 1)::INTEGER, 1) || s FROM b WHERE n > 0)
      SELECT event_id, CASE WHEN s = '' THEN '0' ELSE s END AS b36, epoch_us(ts) // 1000 AS millis, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS rfc3339, value::FLOAT::DOUBLE AS narrow FROM b JOIN events USING (event_id) WHERE n = 0""",
    "product_front_matter": """SELECT 'P' || p_partkey AS product_id, p_brand AS model, p_name AS product_name, p_type AS install_type, p_size AS angle, 'a' || p_size || '+b' AS variants,
      '# ' || p_name || chr(10) || 'body' AS content, true AS no_cup FROM part""",
    "metadata_overlay": "SELECT doc_id, lang, 'own-' || lang AS source, n_chars::VARCHAR AS chars, 3 AS entries FROM documents",
    "generated_ids": "SELECT count(*) AS n, count(*) AS distinct_ids, count(*) AS well_formed FROM events",
    "name_checks": """SELECT c_custkey, c_custkey % 3 = 1 AS good_name, (c_custkey % 4 <> 0) = (c_custkey % 5 <> 0) AND c_custkey * 97 - 97 BETWEEN 1 AND 65535 AS good_address FROM customer""",
}
ORACLES["load_product_files"] = ORACLES["product_front_matter"]
