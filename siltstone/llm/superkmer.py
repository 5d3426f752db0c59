"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. A word is removed if it
lies in a window whose word sequence also starts earlier, by document id and
then by position.

Consecutive windows that share a minimiser (the least hash of their runs of
MINIMISER words) travel together as one packed string, to the bucket of the
minimiser. There windows are sorted by hash, equal neighbours are told apart by
their words, and every window but the first of its kind is reported.

Skew is met in two places. Each map task sends a packed string once: windows of
its later occurrences in the task start earlier in the first one, so those are
removed on the spot. And minimisers are counted beforehand, by bins; windows
whose minimiser falls in a heavy bin travel one by one under their own hash, so
that passages or phrases that very many documents share spread over all buckets.

Defined cases: null or blank text has no words and an empty remainder; texts
shorter than a window keep all words; of repeated ids, the row whose text sorts
first counts as earlier, and rows equal in both are one document; a null id
comes after all others. Other columns are carried along untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.names import fresh
from siltstone.runtime import cut

WINDOW, MINIMISER = 20, 2
#: Packed words that a bucket is to hold.
BUCKET_WORDS = 1 << 18
#: Minimisers are counted in bins, so many that a bin holds about a quarter of a bucket, between these two; a bin is
#: heavy if it has over HEAVY buckets' words, or, past the most bins, over four HEAVY times the mean of all.
BINS_LEAST, BINS_MOST, HEAVY = 1 << 12, 1 << 20, 2
#: Bytes of a word that are packed; a longer one travels as its SHA-256 digest, after a byte that no UTF-8 text has.
LONGEST_WORD = 1 << 12
#: Bytes of text that a map task packs at a time.
GATHERED_BYTES = 8 << 20
#: Windows in a packed string at most; more of one minimiser make several strings.
STRING_WINDOWS = 2048

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_STEP = 0xD6E8FEB86659FD93
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SEGMENT = 1 << 18


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


_VALUES = _mix(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of an odd constant and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], by prefix sums; starts and ends ascend."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(starts, base + _SEGMENT))
        lo, hi = starts[i:j] - base, ends[i:j] - base
        up, down = _powers_to(max(2 * _SEGMENT, int(hi[-1]) + 1))
        sums = np.zeros(int(hi[-1]) + 1, np.uint64)
        np.cumsum(_VALUES[data[base : base + len(sums) - 1]] * up[: len(sums) - 1], out=sums[1:])
        out[i:j] = (sums[hi] - sums[lo]) * down[lo]
        i = j
    return _mix(out)


def shortened(text: bytes) -> bytes:
    """The text, or its words one blank apart with digests for those over LONGEST_WORD bytes."""
    if len(text) <= LONGEST_WORD:
        return text
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST_WORD:
        return text
    return b" ".join(w if len(w) <= LONGEST_WORD else b"\xff" + hashlib.sha256(w).hexdigest().encode() for w in words)


class Words:
    """Texts' words in one buffer, single blanks between them: byte spans, and the text each is in."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts), np.uint8)
        blank = _BLANK[data]
        first, keep = ~blank, ~blank
        first[1:] &= blank[:-1]
        keep[1:] |= ~blank[:-1]
        self.data = np.where(blank, np.uint8(32), data)[keep]
        ends = np.flatnonzero(self.data == 32).astype(np.int32)
        if len(self.data) and self.data[-1] != 32:
            ends = np.append(ends, np.int32(len(self.data)))
        self.ends = ends
        self.starts = np.concatenate((np.zeros(min(1, len(ends)), np.int32), ends[:-1] + np.int32(1)))
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.owner = (np.searchsorted(edges, np.flatnonzero(first), side="right") - 1).astype(np.int32)
        self.first = np.searchsorted(self.owner, np.arange(len(texts))).astype(np.int32)


def minimisers(h: np.ndarray) -> np.ndarray:
    """For each window of the words' hashes h, the least hash of its runs of MINIMISER words."""
    low = h[: len(h) - MINIMISER + 1].copy()
    for k in range(1, MINIMISER):
        low *= _A
        low += h[k : len(h) - MINIMISER + 1 + k]
    low = _mix(low)
    width, span = WINDOW - MINIMISER + 1, 1
    while 2 * span <= width:
        np.minimum(low[:-span], low[span:], out=low[:-span])
        low = low[:-span]
        span *= 2
    return np.minimum(low[: len(h) - WINDOW + 1], low[width - span :])


def _runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (index of their first word), their minimisers, and the edges of runs of windows."""
    n = len(words.ends)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(1, np.int64)
    at = np.flatnonzero(words.owner[: n - WINDOW + 1] == words.owner[WINDOW - 1 :]).astype(np.int32)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(1, np.int64)
    m = minimisers(span_hashes(words.data, words.starts, words.ends))[at]
    new = np.concatenate(([True], (m[1:] != m[:-1]) | (np.diff(at) != 1)))
    begun = np.flatnonzero(new)
    within = np.arange(len(at), dtype=np.int32) - np.repeat(begun.astype(np.int32), np.diff(np.append(begun, len(at))))
    return at, m, np.append(np.flatnonzero(within % STRING_WINDOWS == 0), len(at))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of rows, the text last, of about GATHERED_BYTES."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            row = tuple(x.as_py() for x in row)
            if row[-1]:
                held.append(row)
                size += len(row[-1])
            if size >= GATHERED_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _counted(batches: Iterator[pa.RecordBatch], bins: int) -> Iterator[pa.RecordBatch]:
    strings, windows = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
    for rows in _gathered(batches):
        _, m, edges = _runs(Words([shortened(text) for text, in rows]))
        at = (m[edges[:-1]] % np.uint64(bins)).astype(np.int64)
        np.add.at(strings, at, 1)
        np.add.at(windows, at, np.diff(edges))
    used = np.flatnonzero(strings)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(strings[used]), pa.array(windows[used])], ["bin", "strings", "windows"])


def bins_for(text_bytes: int) -> int:
    """A power of two; words are taken to have six bytes, and to travel about three times."""
    wanted = text_bytes // 2 // (BUCKET_WORDS // 4)
    return min(BINS_MOST, max(BINS_LEAST, 1 << max(0, wanted - 1).bit_length()))


def plan(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Whether each bin is heavy, and the number of buckets; counted over all documents."""
    text = F.col("text").cast("binary")
    bins = bins_for(docs.agg(F.sum(F.length(text))).first()[0] or 0)
    counted = docs.select(text.alias("text")).mapInArrow(lambda batches: _counted(batches, bins), "bin int, strings long, windows long")
    per = cut(counted.groupBy("bin").agg(F.sum("strings").alias("strings"), F.sum("windows").alias("windows")))
    words = F.col("windows") + F.col("strings") * (WINDOW - 1)
    total = per.agg(F.sum(words)).first()[0] or 0
    is_heavy = words > HEAVY * max(BUCKET_WORDS, 4 * total // bins if bins == BINS_MOST else 0)
    heavy = np.zeros(bins, bool)
    heavy[[r["bin"] for r in per.where(is_heavy).select("bin").collect()]] = True  # total / (HEAVY * BUCKET_WORDS) rows, and BINS_MOST / (4 * HEAVY) past the most bins, at most
    packed = per.agg(F.sum(F.when(is_heavy, F.col("windows") * WINDOW).otherwise(words))).first()[0] or 0
    return heavy, max(1, -(-packed // BUCKET_WORDS))


_IDENTITY_BYTES = 17
_SENT = "bucket int, packed binary, doc binary, spans binary"


def _strings(words: Words, heavy: np.ndarray) -> tuple[np.ndarray, ...]:
    """Key, first and past-last word of each packed string."""
    at, m, edges = _runs(words)
    which = heavy[(m[edges[:-1]] % np.uint64(len(heavy))).astype(np.int64)]
    key = m
    if which.any():  # windows of a heavy bin go one by one
        single = np.repeat(which, np.diff(edges))
        cuts = np.zeros(len(m) + 1, bool)
        cuts[edges] = True
        cuts[:-1] |= single
        cuts[1:] |= single
        edges = np.flatnonzero(cuts)
        key = m.copy()
        key[single] = span_hashes(words.data, words.starts[at[single]], words.ends[at[single] + WINDOW - 1])
    return key[edges[:-1]], at[edges[:-1]], at[edges[1:] - 1] + WINDOW


def _sent(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of packed strings (bucket, packed), and of spans found on the spot (bucket, doc, spans)."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=6).compress
    for rows in _gathered(batches):
        by_doc = dict(sorted(rows))
        docs = list(by_doc)
        words = Words([shortened(text) for text in by_doc.values()])
        key, lo, hi = _strings(words, heavy)
        data = words.data.tobytes()
        del rows, by_doc
        pieces = [data[a:b] for a, b in zip(words.starts[lo].tolist(), words.ends[hi - 1].tolist(), strict=True)]
        owner = words.owner[lo]
        start, stop = lo - words.first[owner], hi - words.first[owner]
        seen: set[bytes] = set()
        new = np.zeros(len(pieces), bool)
        for k, piece in enumerate(pieces):
            if piece not in seen:
                seen.add(piece)
                new[k] = True
        out: list[tuple] = []
        again = np.flatnonzero(~new)
        for part in np.split(again, np.flatnonzero(np.diff(owner[again])) + 1) if len(again) else []:
            doc = docs[owner[part[0]]]
            out.append((zlib.crc32(doc) % buckets, None, doc, np.stack([start[part], stop[part]], axis=1).astype("<i4").tobytes()))
        chosen = np.flatnonzero(new)
        bucket = (_mix(key[chosen]) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        chosen, bucket = chosen[order], bucket[order]
        for part, b in zip(np.split(chosen, np.flatnonzero(np.diff(bucket)) + 1), bucket[np.flatnonzero(np.diff(bucket, prepend=-1))].tolist(), strict=True) if len(chosen) else []:
            local, index = np.unique(owner[part], return_inverse=True)
            head = np.concatenate([[len(part), len(local)], index, start[part]]).astype("<i4").tobytes()
            out.append((b, squeeze(head + b"".join(docs[k] for k in local) + b"\n".join([pieces[k] for k in part.tolist()])), None, None))
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        types = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "packed", "doc", "spans"])


def _repeats(blobs: list[bytes]) -> dict[bytes, list[int]]:
    """Document -> starts of its windows in this bucket that are not the first of their kind."""
    docs: list[bytes] = []
    of, begin, texts = [], [], []
    for blob in blobs:
        n, m = np.frombuffer(blob, "<i4", 2).tolist()
        index, start = np.frombuffer(blob, "<i4", 2 * n, 8).reshape(2, n)
        at = 8 + 8 * n
        of.append(index + len(docs))
        begin.append(start)
        docs += [blob[at + k * _IDENTITY_BYTES : at + (k + 1) * _IDENTITY_BYTES] for k in range(m)]
        texts.append(blob[at + m * _IDENTITY_BYTES :])
    data = b"\n".join(texts)
    raw = np.frombuffer(data, np.uint8)
    ends = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = np.flatnonzero(np.append(raw[ends[:-1]] == 10, True))  # the last word of each string
    first = np.concatenate(([0], last[:-1] + 1))
    counts = last - first + 2 - WINDOW
    owner = np.repeat(np.arange(len(last)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    word = first[owner] + within
    a, b = starts[word], ends[word + WINDOW - 1]
    h = span_hashes(raw, a, b)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    found: dict[bytes, list[int]] = {}
    if not same.any():
        return found
    touched = np.concatenate((same, [False])) | np.concatenate(([False], same))
    group = np.cumsum(np.concatenate(([True], ~same)))[touched]
    picked = order[touched]
    of, begin = np.concatenate(of), np.concatenate(begin)
    rows = zip(group.tolist(), a[picked].tolist(), b[picked].tolist(), of[owner[picked]].tolist(), (begin[owner[picked]] + within[picked]).tolist(), strict=True)
    seen: dict[bytes, tuple[bytes, int]] = {}
    current = -1
    for g, lo, hi, doc, start in rows:
        if g != current:
            seen, current = {}, g
        text, at = data[lo:hi], (docs[doc], start)
        earlier = seen.setdefault(text, at)
        if at == earlier:
            continue
        if at < earlier:
            seen[text], at = at, earlier
        found.setdefault(at[0], []).append(at[1])
    return found


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket. Out: (doc, spans), spans as pairs of int32: first and past-last word."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    blobs: list[bytes] = []
    bucket = None

    def judge() -> pa.RecordBatch:
        docs, spans = [], []
        for doc, offsets in _repeats(blobs).items():
            at = np.unique(np.array(offsets, np.int64))
            breaks = np.flatnonzero(np.diff(at) > 1) + 1
            lo, hi = at[np.concatenate(([0], breaks))], at[np.concatenate((breaks - 1, [len(at) - 1]))] + WINDOW
            docs.append(doc)
            spans.append(np.stack([lo, hi], axis=1).astype("<i4").tobytes())
        blobs.clear()
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.binary()), pa.array(spans, pa.binary())], ["doc", "spans"])

    for batch in batches:
        ready = batch.filter(pc.is_valid(batch.column(3)))
        if ready.num_rows:
            yield ready.select(["doc", "spans"])
        rows = batch.filter(pc.is_valid(batch.column(1)))
        for now, packed in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
            if now != bucket and blobs:
                yield judge()
            bucket = now
            blobs.append(expand(packed.as_py()))
    if blobs:
        yield judge()


def _identity(doc_id: Column, text: Column) -> Column:
    """Bytes in the order of documents: ids ascending, null last, equal ids by text digest."""
    known = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    order = F.when(doc_id.isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), known))
    return F.unhex(F.concat(order, F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 16)))


def kept_words(text: bytes | None, spans: list[bytes] | None) -> tuple[list[bytes], int]:
    """The words of text outside the spans, and how many words it has."""
    words = (text or b"").split()
    if not spans:
        return words, len(words)
    change = np.zeros(len(words) + 1, np.int64)
    for part in spans:
        pairs = np.frombuffer(part, "<i4").reshape(-1, 2)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return [words[k] for k in kept.tolist()], len(words)


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, which takes less room in a shuffle than its own compression of rows."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        at = batch.schema.get_field_index("text")
        new = pa.array([None if t is None else squeeze(t.encode()) for t in batch.column(at).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return (None if t is None else expand(t) for t in column.to_pylist())


def with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the text compressed, and a further column: the parts of it to remove, null where there are none; and that column's name."""
    spans_name, of_name, doc_name = fresh(docs, "_spans", "_of", "_doc")
    ident = _identity(docs["doc_id"], docs["text"])
    heavy, buckets = plan(docs)
    narrow = docs.select(ident.alias("doc"), F.col("text").cast("binary").alias("text"))
    sent = narrow.mapInArrow(lambda batches: _sent(batches, heavy, buckets), _SENT)
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_judged, "doc binary, spans binary")
    per = cut(found.groupBy(F.col("doc").alias(doc_name)).agg(F.collect_list("spans").alias(spans_name)))
    known = docs.withColumn(of_name, ident)
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in known.schema)
    joined = known.mapInArrow(_squeezed, schema).join(per, F.col(of_name) == F.col(doc_name), "left")
    return joined.drop(of_name, doc_name), spans_name


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = _texts(batch.column(1)), batch.column(2).to_pylist()
        total, gone, digests = [], [], []
        for text, of_text in zip(texts, spans, strict=True):
            kept, n = kept_words(text, of_text)
            total.append(n)
            gone.append(n - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of docs."""
    spanned, spans = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return spanned.select("doc_id", "text", spans).mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cleaned(batches: Iterator[pa.RecordBatch], spans_name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, sp = batch.schema.get_field_index("text"), batch.schema.get_field_index(spans_name)
        texts, spans = _texts(batch.column(at)), batch.column(sp).to_pylist()
        new = pa.array([b" ".join(kept_words(t, s)[0]) if s else t for t, s in zip(texts, spans, strict=True)], pa.binary()).cast(pa.string())
        columns = [new if k == at else c for k, c in enumerate(batch.columns) if k != sp]
        yield pa.RecordBatch.from_arrays(columns, [n for k, n in enumerate(batch.schema.names) if k != sp])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs whose texts have lost their repeated words; texts that lose none stay as they are."""
    spanned, name = with_spans(docs)
    return spanned.mapInArrow(lambda batches: _cleaned(batches, name), docs.schema)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w)
), again AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM again
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
