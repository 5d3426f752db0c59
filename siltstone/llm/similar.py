"""Near-duplicates by Jaccard similarity of word shingles, with SimHash fingerprints to find the candidates.

Texts of equal shingle sets form one class. A class has a fingerprint of LANES 64-bit
words over its set; tiles of fingerprints are compared as in ``simhash``, first by
one word, then, for the few pairs left, by all of them and by the sizes of their sets.
Those pairs are candidates, and a candidate pair counts if the sets themselves,
made of the texts again, have the similarity asked for.

The sets are compared in two steps, and no pair that is not to be checked becomes a row.
First each class meets the least class among its candidates: a row for each class,
however large its group, so a dense group is done in work that grows as the
group. Then only the groups of candidates that this left in more than one piece are
gone through, a block of texts against another, without the pairs inside a piece.

Chance pairs: unlike sets differ in 128 +- 8 of 256 bits, RADIUS is nine deviations
below, so they don't tie the corpus together. Sets of 0.8 differ in 38.8 +- 5.7.
Ties between set and unset bits, which few shingles have often, go by the least
hash, else texts of two shingles would be near each other by chance.

Defined cases: null or blank text has no words and an empty set, which is equal to
another empty one alone; fewer words than the shingle size give one shingle of all
of them; a text of any length is one set, held whole, 8 bytes a shingle; repeated
rows are one; of ties in the id the row of the least hash of its text stays; a null
doc_id comes last; an empty table gives no rows. Other columns are kept, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import Forest, connected_components, least_of
from siltstone.llm.names import fresh
from siltstone.llm.simhash import shingle_hashes, tile_pairs, words_of
from siltstone.runtime import cut

WORDS, SIMILARITY = 5, 0.8
#: Words of a fingerprint, bits in which candidates differ at most, and in the first word: its 9.7 +- 2.9 at 0.8 are far below.
LANES, RADIUS, FIRST_RADIUS = 4, 56, 22
#: What a block of texts to be checked holds at most, in texts and in bytes; a group is in so many blocks before they
#: fill, of so many texts at least, as several tasks are faster than one.
BLOCK_TEXTS, BLOCK_BYTES, SPLIT_BLOCKS, SPLIT_TEXTS = 4096, 16 << 20, 6, 256
#: Texts that meet one copy of a hub's text.
HUB_TEXTS = 128
#: Candidates' keys are broadcast up to so many rows of some 40 bytes; beyond it texts are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Shingles of a set that are spread to bits at a time, and fingerprints compared at a time.
_AT_ONCE, _BLOCK = 1 << 13, 1024
#: 0.8 isn't a binary fraction; whole numbers must still meet it exactly.
_ROUNDING = 1e-9
_FPS = [f"fp{k}" for k in range(LANES)]


def shingle_set(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles, ascending."""
    parts = [p[:, 0] for p in shingle_hashes(words_of(text), size)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _lane(values: np.ndarray, k: int) -> np.ndarray:
    """Another hash of hashes for each lane, by a 64-bit finaliser (multiply and shift, as in splitmix64)."""
    x = values + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _bits(values: np.ndarray) -> np.ndarray:
    lanes = np.stack([_lane(values, k) for k in range(LANES)], axis=1)
    return np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(len(values), 8 * LANES), axis=1, bitorder="little")


def sketch(values: np.ndarray) -> np.ndarray:
    """LANES words; a bit is set if it is in over half of the set's hashes, or in half of them and in the least hash."""
    if not len(values):
        return np.zeros(LANES, np.uint64)
    ones = sum(_bits(values[k : k + _AT_ONCE]).sum(axis=0, dtype=np.int64) for k in range(0, len(values), _AT_ONCE))
    return np.packbits(2 * ones + _bits(values[:1])[0] > len(values), bitorder="little").view("<u8").astype(np.uint64)


def alike(m: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of such sizes can have the similarity."""
    return np.minimum(m, n) >= similarity * np.maximum(m, n) - _ROUNDING


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as ascending arrays, have that Jaccard similarity."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    if len(a) < len(b):
        a, b = b, a
    both = int((a.take(a.searchsorted(b), mode="clip") == b).sum())
    return both >= similarity * (len(a) + len(b) - both) - _ROUNDING


def pairs(left: np.ndarray, m: np.ndarray, right: np.ndarray | None, n: np.ndarray, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate index pairs, in parts: of left's fingerprints (a row each, m their sets' sizes), or of left's and right's."""
    same = right is None
    cols = left if same else right
    sizes = m if same else n
    lanes_a, lanes_b = ([np.ascontiguousarray(x[:, k]) for k in range(x.shape[1])] for x in (left, cols))
    first = min(FIRST_RADIUS, radius)
    for p in range(0, len(left), _BLOCK):
        for q in range(p if same else 0, len(cols), _BLOCK):
            b = lanes_b[0][None, q : q + _BLOCK]
            i, j = np.divmod(np.flatnonzero(np.bitwise_count(lanes_a[0][p : p + _BLOCK, None] ^ b).reshape(-1) <= first), b.shape[1])
            i, j = i + p, j + q
            if same and p == q:
                i, j = i[i < j], j[i < j]
            apart = sum((np.bitwise_count(x[i] ^ y[j]) for x, y in zip(lanes_a, lanes_b, strict=True)), np.zeros(len(i), np.int64))
            near = (apart <= radius) & alike(m[i], sizes[j], similarity)
            if near.any():
                yield i[near], j[near]


def _prints(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        fps, keys, sizes = np.zeros((LANES, batch.num_rows), np.uint64), np.zeros((2, batch.num_rows), np.uint64), np.zeros(batch.num_rows, np.int64)
        for k, text in enumerate(batch.column(1)):
            values = shingle_set(text.as_py(), size)
            fps[:, k], sizes[k] = sketch(values), len(values)
            keys[:, k] = np.frombuffer(xxhash.xxh3_128_digest(values.astype("<u8").tobytes()), "<u8")
        columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(sizes), *(pa.array(x.view(np.int64)) for x in (*keys, *fps))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "bytes", "size", "k0", "k1", *_FPS])


def _classes(docs: DataFrame, size: int) -> DataFrame:
    """(cid, w, bytes, size, fp0, ...), a row for each shingle set: w is its least row, by id, null last, then by digest."""
    text = F.col("text").cast("binary")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("text").alias("digest"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("bytes"))
    schema = ", ".join(f"{c} long" for c in ["doc_id", "digest", "bytes", "size", "k0", "k1", *_FPS])
    prints = narrow.mapInArrow(lambda batches: _prints(batches, size), schema)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("w")
    per = prints.groupBy("k0", "k1").agg(least, F.max("bytes").alias("bytes"), *[F.first(c).alias(c) for c in ("size", *_FPS)])
    return cut(per.drop("k0", "k1")).withColumn("cid", F.monotonically_increasing_id())


def _candidates(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of each tile pair: a spanning forest (u, v, false) of its candidate pairs, and (u, v, true) with v the least candidate of u, if it is less than u.

    Rows (a, b, tile) come sorted by pair, each pair as two tiles or, of a tile with itself, one.
    """
    held: tuple | None = None

    def result(left: tuple, right: tuple | None) -> pa.RecordBatch:
        nodes = left[0] if right is None else np.concatenate([left[0], right[0]])
        shift = 0 if right is None else len(left[0])
        forest, least = Forest(len(nodes)), nodes.copy()
        for i, j in pairs(left[2], left[1], *((None, left[1]) if right is None else (right[2], right[1])), radius, similarity):
            j = j + shift
            forest.link(i, j)
            np.minimum.at(least, i, nodes[j])
            np.minimum.at(least, j, nodes[i])
        child, root = forest.edges()
        less = np.flatnonzero(least < nodes)
        u, v = np.concatenate([nodes[child], nodes[less]]), np.concatenate([nodes[root], least[less]])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.arange(len(u)) >= len(child))], ["u", "v", "hub"])

    for batch in batches:
        for k in range(batch.num_rows):
            a, b = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            node, size, *lanes = (np.array(x.to_numpy(zero_copy_only=False), np.int64) for x in batch.column(2)[k].values.flatten())
            tile = node, size, np.stack(lanes, axis=1).view(np.uint64)
            if a == b:
                yield result(tile, None)
            elif held and held[:2] == (a, b):
                yield result(held[2], tile)
                held = None
            else:
                held = (a, b, tile)


def _row(doc_id: str | Column, digest: Column) -> list[Column]:
    """What tells rows apart in a join, without nulls."""
    doc = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return [doc.isNull(), F.coalesce(doc.cast("long"), F.lit(0)), digest]


def _sized(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each cid, the first column, in the task."""
    seen: set[int] = set()
    for batch in batches:
        new = []
        for cid in batch.column(0).to_pylist():
            new.append(cid not in seen)
            seen.add(cid)
        yield batch.filter(pa.array(new, pa.bool_()))


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (cid, ...), each cid once, with a text of the class."""
    names = ("last", "id", "row")
    keyed = cut(classes.select("cid", *(c.alias(n) for c, n in zip(_row("w.doc_id", F.col("w.digest")), names, strict=True))).join(wanted, "cid"))
    texts = docs.select(*(c.alias(n) for c, n in zip(_row("doc_id", F.xxhash64("text")), names, strict=True)), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = texts.join(_sized(keyed), list(names)).select(*keyed.columns, "text").drop(*names)
    # A row that repeats without limit leaves a task once.
    return found.mapInArrow(_once, found.schema)


def _to_hubs(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (hub, block, member, cid, text) come sorted by the first three, the hub's own text first: (cid, hub) of the similar ones."""
    hub, values = None, np.zeros(0, np.uint64)
    for batch in batches:
        u, v = [], []
        for at, member, cid, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), batch.column(4), strict=True):
            if not member:
                hub, values = at, shingle_set(text.as_py(), size)
            elif at == hub and similar(values, shingle_set(text.as_py(), size), similarity):
                u.append(cid), v.append(at)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _near_hubs(docs: DataFrame, classes: DataFrame, found: DataFrame, size: int, similarity: float) -> DataFrame:
    """(u, v): the classes that are similar to the least of their candidates, a row each."""
    own = cut(found.where("hub").groupBy("u").agg(F.min("v").alias("v")))
    hubs = cut(own.groupBy("v").agg(F.ceil(F.count("*") / HUB_TEXTS).cast("int").alias("blocks")))
    large = hubs.where("blocks > 1").select("v", F.col("blocks").alias("parts"))
    placed = own.join(_sized(large), "v", "left").select(F.col("u").alias("cid"), F.col("v").alias("hub"), F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).cast("int").alias("block"))
    wanted = placed.join(hubs.select(F.col("v").alias("cid"), "blocks"), "cid", "full").select("cid", "hub", "block", "blocks")
    texts = _texts(docs, classes, wanted)
    as_member = F.when(F.col("hub").isNotNull(), F.array(F.struct(F.col("hub").alias("hub"), F.col("block").alias("block"), F.lit(True).alias("member"))))
    as_hub = F.when(F.col("blocks") > 0, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("cid").alias("hub"), k.alias("block"), F.lit(False).alias("member"))))
    none = F.array().cast("array<struct<hub: bigint, block: int, member: boolean>>")
    roles = texts.select("cid", "text", F.explode(F.concat(F.coalesce(as_member, none), F.coalesce(as_hub, none))).alias("as")).select("as.hub", "as.block", "as.member", "cid", "text")
    dealt = roles.repartition("hub", "block").sortWithinPartitions("hub", "block", "member")
    return dealt.mapInArrow(lambda batches: _to_hubs(batches, size, similarity), "u long, v long")


def _verified(batches: Iterator[pa.RecordBatch], size: int, radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (component, a, b, side, cid, piece, text) come sorted by the first four; a group is one block of texts, or two.

    Out: a spanning forest (u, v) of the similar pairs among the group's candidates, given that a piece is linked.
    """
    held: dict[int, tuple] = {}
    key = None

    def result() -> pa.RecordBatch:
        split = sum(1 for side, *_ in held.values() if side == 0)
        cids, fps, sets = np.array(list(held), np.int64), np.stack([x[2] for x in held.values()]), [x[3] for x in held.values()]
        sizes = np.array([len(s) for s in sets])
        forest = Forest(len(sets))
        _, first, piece = np.unique([x[1] for x in held.values()], return_index=True, return_inverse=True)
        forest.link(np.arange(len(sets)), first[piece])
        same = key[1] == key[2]
        sides = (fps, sizes, None, sizes) if same else (fps[:split], sizes[:split], fps[split:], sizes[split:])
        for i, j in pairs(*sides, radius, similarity) if same or 0 < split < len(sets) else ():
            j = j if same else j + split
            for x, y in np.stack([i, j], axis=1)[forest.label[i] != forest.label[j]].tolist():
                if forest.label[x] != forest.label[y] and similar(sets[x], sets[y], similarity):
                    forest.link(np.array([x]), np.array([y]))
        child, root = forest.edges()
        return pa.RecordBatch.from_arrays([pa.array(cids[child]), pa.array(cids[root])], ["u", "v"])

    for batch in batches:
        fields = [batch.column(k).to_pylist() for k in range(6)]
        for k, text in enumerate(batch.column(6)):
            if (now := (fields[0][k], fields[1][k], fields[2][k])) != key:
                if len(held) > 1:
                    yield result()
                held, key = {}, now
            if fields[4][k] not in held:
                values = shingle_set(text.as_py(), size)
                held[fields[4][k]] = (fields[3][k], fields[5][k], sketch(values), values)
    if len(held) > 1:
        yield result()


def _in_blocks(docs: DataFrame, classes: DataFrame, nodes: DataFrame, size: int, radius: int, similarity: float) -> DataFrame:
    """nodes (cid, component, piece): (u, v), edges whose components, with the pieces, are those of all similar candidate pairs of a component."""
    keyed = cut(classes.select("cid", "bytes").join(nodes, "cid"))
    sizes = keyed.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    split = F.least(F.ceil(F.col("n") / SPLIT_TEXTS), F.lit(SPLIT_BLOCKS))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("bytes") / BLOCK_BYTES), split).cast("int")
    large = cut(sizes.select("component", blocks.alias("blocks")).where("blocks > 1"))
    wanted = keyed.drop("bytes").join(_sized(large), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = _texts(docs, classes, wanted).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a, b = F.least("block", "other"), F.greatest("block", "other")
    rows = paired.select("component", a.alias("a"), b.alias("b"), (F.col("block") > a).cast("int").alias("side"), "cid", "piece", "text")
    dealt = rows.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "side")
    return dealt.mapInArrow(lambda batches: _verified(batches, size, radius, similarity), "u long, v long")


def _open(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, component, piece) of the classes in groups of candidates that the labels so far leave in several pieces."""
    every = candidates.union(candidates.select("component", "component").distinct()).toDF("cid", "component")
    nodes = every.join(labels.toDF("cid", "piece"), "cid", "left").select("cid", "component", F.coalesce("piece", "cid").alias("piece"))
    several = nodes.groupBy("component").agg(F.min("piece").alias("low"), F.max("piece").alias("high")).where("low <> high").select("component")
    return nodes.join(_sized(cut(several)), "component").select("cid", "component", "piece")


def labelled(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, size: int = WORDS) -> DataFrame:
    """(node, component) of the classes' components by similarity, as connected_components gives them."""
    tiles = tile_pairs(classes, radius, _FPS, "size")
    found = cut(tiles.mapInArrow(lambda batches: _candidates(batches, radius, similarity), "u long, v long, hub boolean"))
    near = cut(_near_hubs(docs, classes, found, size, similarity))
    labels = connected_components(near)
    rest = cut(_open(connected_components(found.where("not hub").select("u", "v")), labels))
    if rest.isEmpty():
        return labels
    return connected_components(labels.toDF("u", "v").union(_in_blocks(docs, classes, rest, size, radius, similarity)))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, size: int = WORDS) -> DataFrame:
    """docs with one row of each group linked by shingle sets of that Jaccard similarity, as far as the radius finds them.

    The row of the least id stays, null last, then that of the least hash of its text; rows equal in both are one.
    """
    classes = _classes(docs, size)
    labels = labelled(docs, classes, similarity, radius, size)
    least = least_of(labels, classes.select(F.col("cid").alias("node"), F.col("w").alias("value")))
    known = classes.join(least, classes["cid"] == least["node"], "left")
    winners = known.where("value is null or value = w").select(*(c.alias(n) for c, n in zip(_row("w.doc_id", F.col("w.digest")), ("last", "id", "digest"), strict=True)))
    names = fresh(docs, "_last", "_id", "_digest")
    kept = cut(winners).toDF(*names)
    marked = docs.select("*", *(c.alias(n) for c, n in zip(_row(docs["doc_id"], F.xxhash64(docs["text"])), names, strict=True)))
    # Made distinct map-side first and joined by the same keys, so each text is shuffled once.
    return marked.dropDuplicates(names).join(kept, names, "left_semi").select(*docs.columns)
