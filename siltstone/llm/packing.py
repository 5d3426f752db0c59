"""Cost-balanced packing of documents into sequences.

Attention over a piece of n tokens is estimated to cost LINEAR * n + QUADRATIC
* n^2. Pieces go in descending order of cost (of tokens, where costs tie), each
to the sequence of lowest cost that has tokens left; what does not fit there is
cut off and goes to the next such sequence. A piece as long as a sequence costs
the most a sequence can, so long documents are cut, evenly, only as finely as it
takes for the costs of full sequences to meet.

A group of documents is packed at a time, GROUP_TOKENS tokens or the whole
partition, so memory is bounded and nothing is shuffled. A group's sequences
hold exactly its tokens: full ones, and powers of two for the rest, which need
no padding either.

Defined cases: null and empty texts are their end id alone; repeated rows and
ids are packed like any other; an empty table gives no rows. A sequence_id is
unique, and repeats in a rerun over the same partitions.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tokens import default_path, encoder

SEQUENCE_TOKENS = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
GROUP_TOKENS = 1 << 22
#: The largest cost of a full sequence over their mean that is aimed at, and the finest cut, a sequence in so many pieces.
SPREAD, PARTS_MOST = 1.1, 16


def cost(tokens: int) -> float:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def capacities(tokens: int, most: int = SEQUENCE_TOKENS) -> list[int]:
    """Of a group's sequences: full ones, then the powers of two that make up the rest."""
    full, rest = divmod(tokens, most)
    return [most] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def cut_at(lengths: list[int], most: int) -> list[tuple[int, int, int]]:
    """(document index, start, length): each document in as few pieces of at most `most` tokens as will do, of like lengths."""
    pieces = []
    for i, n in enumerate(lengths):
        k = -(-n // most)
        edges = [n * j // k for j in range(k + 1)]
        pieces += [(i, a, b - a) for a, b in zip(edges, edges[1:])]
    return pieces


def placed(pieces: list[tuple[int, int, int]], room: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Pieces in descending order of cost, each into the sequence of lowest cost with room; and the sequences' costs."""
    filled, spent = [0] * len(room), [0.0] * len(room)
    heap = [(0.0, -c, k) for k, c in enumerate(room)]
    heapq.heapify(heap)
    out = []
    for i, at, n in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        while n:
            _, _, k = heapq.heappop(heap)
            take = min(n, room[k] - filled[k])
            out.append((i, at, take, k, filled[k]))
            filled[k] += take
            spent[k] += cost(take)
            at, n = at + take, n - take
            if filled[k] < room[k]:
                heapq.heappush(heap, (spent[k], filled[k] - room[k], k))
    return out, spent


def spread(spent: list[float], room: list[int], most: int) -> float:
    """The largest cost of a full sequence over the mean of such; 1 if there are none."""
    full = [c for c, r in zip(spent, room, strict=True) if r == most]
    return max(full) * len(full) / sum(full) if full else 1.0


def assign(lengths: list[int], most: int = SEQUENCE_TOKENS) -> list[tuple[int, int, int, int, int]]:
    """(document index, start, length, sequence index, offset) of each piece; every token is in exactly one.

    Cuts are as few as balance allows: pieces of up to `most` tokens, else of a
    half, a third and so on, until the spread is SPREAD at most; the best of all
    if none is.
    """
    room = capacities(sum(lengths), most)
    best: tuple | None = None
    for parts in range(1, PARTS_MOST + 1):
        out, spent = placed(cut_at(lengths, max(1, most // parts)), room)
        now = spread(spent, room, most)
        if best is None or now < best[0]:
            best = now, out
        if now <= SPREAD:
            break
    return best[1]


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packed(batches: Iterator[pa.RecordBatch], path: str, most: int, group: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, end = encoder(path), END_ID.to_bytes(4, "little")
    first = TaskContext.get().partitionId() << 33
    ids: list[bytes] = []
    docs: list[int | None] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal first
        lengths = [len(x) // 4 for x in ids]
        pieces = assign(lengths, most)
        doc, start, length, seq, offset = zip(*pieces, strict=True)
        parts = [ids[i][4 * s : 4 * (s + n)] for i, s, n, _, _ in pieces]
        columns = [
            pa.array([docs[i] for i in doc], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
            pa.array(list(map(zlib.crc32, parts)), pa.int64()), pa.array([lengths[i] for i in doc], pa.int64()),
            pa.array(np.array(seq, np.int64) + first), pa.array(offset, pa.int64()),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32())))
            names.append("ids")
        first += max(seq) + 1
        ids.clear(), docs.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(encode(text.as_py()) + end)
            docs.append(doc)
            held += len(ids[-1]) // 4
            if held >= group:
                yield flush()
                held = 0
    if ids:
        yield flush()


def pack(docs: DataFrame, path: str | None = None, most: int = SEQUENCE_TOKENS, group: int = GROUP_TOKENS, with_ids: bool = True) -> DataFrame:
    """One row per piece; with_ids adds the piece's ids, from which sequences are assembled by offset."""
    path = path or default_path()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    return narrow.mapInArrow(lambda batches: _packed(batches, path, most, group, with_ids), schema)
