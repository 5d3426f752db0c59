"""Fill-in-the-middle transformation and its inverse, with DataFrame functions only.

``regexp_extract_all`` makes the array of units, four numbers from the SHA-256 of
seed and id give the two cuts and the form, and slices of the array joined round
three sentinels make the output. ``restore`` finds the sentinels again and puts
the parts back in order. Nothing is shuffled and no Python runs: every row is
done where it is read, whole, whatever its length.

Defined cases: a null text is an empty one, which has no units and stays plain;
so does a text that holds a sentinel, as it could not be told from ours; a null
doc_id hashes as an empty string; repeated rows of one id get equal cuts; an
empty table gives no rows. Only doc_id and text are read, so other columns,
whatever their names, do not matter. A text's units are held as one array, some
40 bytes each, so a text of 100 million units needs an executor of some gigabytes.
"""

from __future__ import annotations

import re
from itertools import permutations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.names import fresh

#: A unit is a run of ASCII letters or any other single character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
SEED = "1"
SENTINELS = ("<P>", "<S>", "<M>")
#: Per cent of the documents that are transformed, and of those the ones whose suffix comes first.
FIM_PER_CENT, SPM_PER_CENT = 90, 20


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels must be told apart wherever text stands beside them: no end of one may begin another."""
    joint = any(b.startswith(a[-k:]) for a, b in product(sentinels, repeat=2) for k in range(1, len(a)))
    if not all(sentinels) or joint or any(a in b for a, b in permutations(sentinels, 2)):
        raise ValueError(f"sentinels must not be empty, repeat or overlap: {sentinels}")
    return sentinels


def _number(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, from 0, as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: str = SEED, fim_per_cent: int = FIM_PER_CENT, spm_per_cent: int = SPM_PER_CENT, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of docs (doc_id, text).

    n is the number of units. form is plain (output is the text), psm (prefix, suffix,
    middle) or spm (suffix, prefix, middle), each part behind its sentinel; the middle
    comes last in both. The lengths are in code points, null if plain.
    """
    p, s, m = map(F.lit, _checked(sentinels))
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    numbered = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), digest.alias("digest"))
    n = F.size("units")
    one, two, plain, order = (_number(F.col("digest"), k) for k in range(4))
    cut_one, cut_two = F.pmod(one, n + 1), F.pmod(two, n + 1)
    held = F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    form = F.when((n == 0) | held | (plain % 100 >= fim_per_cent), "plain").when(order % 100 < spm_per_cent, "spm").otherwise("psm")
    placed = numbered.select(
        "doc_id", "text", "units", n.alias("n"), form.alias("form"), F.least(cut_one, cut_two).cast("int").alias("a"), F.greatest(cut_one, cut_two).cast("int").alias("b")
    )

    def part(first: Column | int, size: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("units", first, size), ""))

    parts = placed.select(
        "doc_id", "text", "n", "form", part(1, F.col("a")).alias("prefix"), part(F.col("a") + 1, F.col("b") - F.col("a")).alias("middle"), part(F.col("b") + 1, F.col("n") - F.col("b")).alias("suffix")
    )
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return parts.select(
        "doc_id", F.col("n").cast("long").alias("n"), "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output")
    )


def restore(done: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """done (form, output, ...) with the text that output was made of, as a last column restored (behind underscores if done has that name); null if output isn't of its form."""
    split, moved = fresh(done, "_found", "restored")
    found = done.select("*", F.split("output", "|".join(map(re.escape, _checked(sentinels))), -1).alias(split))
    lead, first, second, middle = (F.get(split, F.lit(k)) for k in range(4))
    p, s, m = map(F.lit, sentinels)
    psm = F.when(F.startswith("output", p), F.when(F.concat(lead, p, first, s, second, m, middle) == F.col("output"), F.concat(first, middle, second)))
    spm = F.when(F.startswith("output", s), F.when(F.concat(lead, s, first, p, second, m, middle) == F.col("output"), F.concat(second, middle, first)))
    text = F.when(F.col("form") == "plain", F.col("output")).when(F.size(split) != 4, None).when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm)
    return found.select(*[found[c] for c in done.columns], text.alias(moved))


def digest(restored: DataFrame) -> DataFrame:
    """The columns of restore's result with hashes in place of the texts."""
    return restored.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256")
    )


ORACLE = r"""
WITH numbered AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), hashed AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n,
         ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM numbered
), placed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashed
), parts AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
