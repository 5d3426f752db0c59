"""SimHash near-dedup by tiled exact comparison.

Documents become fingerprints of their word shingles: LANES 64-bit words, a bit
being set if it is in over half of the shingles' hashes. Equal fingerprints form
one class. Classes are cut into tiles by population count, and tile pairs whose
counts differ by more than the radius are never formed. Inside a task, blocks of
both tiles are skipped when the counts of their quarters differ by more than the
radius together; the rest is compared exactly with exclusive-or and bit counts.
A task returns a spanning forest of its links, not the links.

``near_duplicates`` links by the radius alone; ``similar`` has the stage that holds
candidates against the Jaccard similarity of their shingle sets.

Defined cases: null or blank text has no words and fingerprint 0, which links
like any other; fewer words than the shingle size give one shingle of all of
them; repeated rows and ids are separate rows of one class; a null doc_id gets
the least non-null id of its component, null if there is none; an empty table
gives no rows. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import Forest, connected_components, least_of
from siltstone.runtime import cut

SHINGLE_WORDS = 4
HASH_SEED = 42
RADIUS = 4
#: Fingerprints in a tile: this at least, and a share of all so that the number of pairs levels off.
TILE_LEAST, TILE_MOST, TILES_AIMED = 2048, 1 << 18, 32
#: Shingles of a text that are hashed at a time.
_AT_ONCE = 1 << 14


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingle_hashes(words: list[bytes], size: int, lanes: int = 1) -> Iterator[np.ndarray]:
    """Unsigned XXH64 values of the shingles, a row each, a column for each lane's seed; in parts of _AT_ONCE rows."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    k = min(size, len(words))
    for at in range(0, len(words) - k + 1 if words else 0, _AT_ONCE):
        part = words[at : at + _AT_ONCE + k - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(part) - k + 1]
        spans = [joined[a:b] for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)]
        yield np.stack([np.fromiter((digest(s, HASH_SEED + lane) for s in spans), np.uint64, len(spans)) for lane in range(lanes)], axis=1)


def majority(parts: Iterable[np.ndarray], lanes: int = 1) -> np.ndarray:
    """One unsigned word a lane; a bit is set if it is set in over half of all rows."""
    ones, n = np.zeros(64 * lanes, np.int64), 0
    for part in parts:
        n += len(part)
        ones += np.unpackbits(np.ascontiguousarray(part, "<u8").view(np.uint8).reshape(-1, 8 * lanes), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(text: bytes | None) -> int:
    """Unsigned, of one lane."""
    return int(majority(shingle_hashes(words_of(text), SHINGLE_WORDS))[0])


def _prints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.zeros(batch.num_rows, np.uint64)
        for k, text in enumerate(batch.column(1)):
            fps[k] = majority(shingle_hashes(words_of(text.as_py()), size))[0]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "digest", "fp0"])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, digest, fp0): a hash of the text as it is, and its fingerprint, as signed longs."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("digest"))
    return narrow.mapInArrow(lambda batches: _prints(batches, size), "doc_id long, digest long, fp0 long")


def _bands(counts: dict[int, int], tile: int) -> list[tuple[int, int, int]]:
    """(least popcount, largest popcount, number of tiles): rare counts share a tile, frequent ones are split."""
    bands: list[list[int]] = []
    for pop in sorted(counts):
        if bands and bands[-1][2] + counts[pop] <= tile:
            bands[-1][1:] = [pop, bands[-1][2] + counts[pop]]
        else:
            bands.append([pop, pop, counts[pop]])
    return [(lo, hi, -(-n // tile)) for lo, hi, n in bands]


class _Side:
    """A tile's fingerprints, a row each, in blocks of like population counts."""

    def __init__(self, x: np.ndarray, size: int = 512):
        quarters = np.bitwise_count(x[:, :, None] >> np.arange(0, 64, 16, dtype=np.uint64) & np.uint64(0xFFFF)).astype(np.int16).reshape(len(x), 4 * x.shape[1])
        self.order = np.lexsort(quarters.T[::-1])
        quarters = quarters[self.order]
        lanes = [np.ascontiguousarray(x[self.order, k]) for k in range(x.shape[1])]
        self.blocks = [
            (self.order[at : at + size], [lane[at : at + size] for lane in lanes], quarters[at : at + size].min(axis=0), quarters[at : at + size].max(axis=0))
            for at in range(0, len(x), size)
        ]


def _near(a: list[np.ndarray], b: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    apart = np.bitwise_count(a[0][:, None] ^ b[0][None, :])
    for x, y in zip(a[1:], b[1:], strict=True):
        apart += np.bitwise_count(x[:, None] ^ y[None, :])
    flat = np.flatnonzero(apart.reshape(-1) <= radius)
    return np.divmod(flat, len(b[0]))


def _pairs(left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius, in parts: of left's rows, or of left's and (counted on) right's."""
    rows = _Side(left)
    cols = rows if right is None else _Side(right)
    shift = 0 if right is None else len(left)
    for p, (at, a, lo, hi) in enumerate(rows.blocks):
        for bt, b, low, high in cols.blocks[p:] if right is None else cols.blocks:
            if np.maximum(np.maximum(low - hi, lo - high), 0).sum() > radius:
                continue
            i, j = _near(a, b, radius)
            if len(i):
                yield at[i], bt[j] + shift


def _compare(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links within left, or between left and right."""
    forest = Forest(len(left) + (0 if right is None else len(right)))
    for i, j in _pairs(left, right, radius):
        forest.link(i, j)
    return forest.edges()


def _compared(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, tile) come sorted by pair, each pair as two tiles or, of a tile with itself, one."""
    held: tuple | None = None

    def result(nodes: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> pa.RecordBatch:
        child, root = _compare(left, right, radius)
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root])], ["u", "v"])

    for batch in batches:
        for k in range(batch.num_rows):
            a, b = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            node, *lanes = (np.array(x.to_numpy(zero_copy_only=False), np.int64) for x in batch.column(2)[k].values.flatten())
            tile = np.stack(lanes, axis=1).view(np.uint64)
            if a == b:
                yield result(node, tile, None)
            elif held and held[:2] == (a, b):
                yield result(np.concatenate([held[2], node]), held[3], tile)
                held = None
            else:
                held = (a, b, node, tile)


def tile_pairs(classes: DataFrame, radius: int, fps: list[str], *carried: str) -> DataFrame:
    """classes (cid, fingerprint columns, carried ones) -> (a, b, xs): for each pair of tiles within reach two rows, of a tile with itself one.

    xs are a tile's structs of cid, carried columns and fingerprint; a task has the rows of a pair side by side.
    """
    pop = sum((F.bit_count(c) for c in fps), F.lit(0))
    counts = {int(r["pop"]): int(r["n"]) for r in classes.groupBy(pop.alias("pop")).agg(F.count("*").alias("n")).collect()}  # 64 rows a word, and one
    total = sum(counts.values())
    bands = _bands(counts, min(TILE_MOST, max(TILE_LEAST * len(fps), total // TILES_AIMED))) or [(0, 64 * len(fps), 1)]
    band = F.lit(0)
    for k, (lo, _, _) in enumerate(bands):
        band = F.when(pop >= lo, F.lit(k)).otherwise(band)
    firsts = np.cumsum([0] + [n for _, _, n in bands]).tolist()
    placed = classes.select("cid", *carried, *fps, band.alias("band"))
    at = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("band") + 1)
    tiles = placed.select(
        "band", (at(firsts[:-1]) + F.pmod(F.xxhash64("cid"), at([n for _, _, n in bands]))).cast("int").alias("tile"), F.struct("cid", *carried, *fps).alias("x")
    ).groupBy("band", "tile").agg(F.collect_list("x").alias("xs"))
    # The tiles within reach of a band are consecutive: bands are in order of their counts.
    reach = [[k for k, (lo, hi, _) in enumerate(bands) if lo - bands[j][1] <= radius and bands[j][0] - hi <= radius] for j in range(len(bands))]
    first, last = at([firsts[r[0]] for r in reach]), at([firsts[r[-1] + 1] - 1 for r in reach])
    pairs = tiles.select("tile", "xs", F.explode(F.sequence(first, last)).alias("other")).select(
        F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "xs"
    )
    return pairs.repartition("a", "b").sortWithinPartitions("a", "b")


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """classes (cid, fp0) -> (u, v): edges of cids whose components are those of all pairs within the radius."""
    return tile_pairs(classes, radius, ["fp0"]).mapInArrow(lambda batches: _compared(batches, radius), "u long, v long")


def _classes(prints: DataFrame) -> DataFrame:
    """(cid, fp0, w), a row for each class: w is its least row, by id, null last, then by digest."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("w")
    return cut(prints.groupBy("fp0").agg(least)).withColumn("cid", F.monotonically_increasing_id())


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of docs."""
    prints = cut(fingerprints(docs))
    classes = _classes(prints)
    labels = connected_components(links(classes, radius))
    least = least_of(labels, classes.select(F.col("cid").alias("node"), F.col("w").alias("value")))
    by_class = classes.join(least, classes["cid"] == least["node"], "left").select(F.col("fp0").alias("fp"), F.coalesce("value", "w")["doc_id"].alias("component_id"))
    return prints.select("doc_id", F.col("fp0").alias("fp")).join(by_class, "fp", "left").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
