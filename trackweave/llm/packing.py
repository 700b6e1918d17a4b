"""Token ids packed into rows of one length by best-fit decreasing.

Texts are tokenized, cut into pieces of at most the row length, and packed buffer by buffer: the pieces of a buffer go
by falling length, each into the open row with the least room that still holds it. Open rows are kept by their room; a
segment tree over the rooms 0..length finds the least one that is large enough. A buffer is a bounded part of one
input partition, so nothing is shuffled and a lost task packs its own rows again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.bpe import VOCABULARY

#: Tokens of a row, tokens of a buffer, and the id that fills a row's end (free in the vocabulary).
LENGTH, BUFFER_TOKENS, PAD = 2048, 4_000_000, 50_256


class RoomTree:
    """Segment tree over rooms 0..limit; a node counts the rooms below it that some open row has."""

    def __init__(self, limit: int) -> None:
        self.leaves = 1 << limit.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(limit + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        if len(self.rows[room]) == 1:
            self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The least room of at least size with one of its rows, which is taken out."""
        count, node = self.count, size + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._add(room, -1)
        return room, row

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """The rows, as lists of indices into sizes (each 1..length). Ties: the earlier piece first."""
    tree, rows = RoomTree(length), []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[piece])
        if found is None:
            found = length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(piece)
        if room > sizes[piece]:
            tree.put(room - sizes[piece], row)
    return rows


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    import tiktoken

    from trackweave.llm.bpe import vocabulary

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: r for r, t in vocabulary(path).spelled.items()}, special_tokens={})


def id_width(path: str, length: int, pad: int) -> np.dtype:
    """The type that holds every id of the vocabulary, the padding and every position; ids of 2**32 and more fail."""
    from trackweave.llm.bpe import vocabulary

    largest = max(pad, length - 1, *vocabulary(path).spelled)
    if largest >= 1 << 32 or pad < 0:
        raise ValueError(f"ids must be from 0 to 2**32 - 1, not {largest if pad >= 0 else pad}")
    return np.dtype("<u2" if largest < 1 << 16 else "<u4")


def pack(docs: DataFrame, path: str, pattern: str, ident: str = "doc_id", text: str = "text", length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """A row for each packed row of ids.

    Columns: shard (input partition), pack (number in it), n_tokens (without padding), input_ids (little-endian unsigned
    integers, length of them, the end filled with pad), cu_seqlens (array<int>, 0 and the ends of the segments),
    position_ids (likewise, starting at 0 in each segment, 0 in the padding), doc_ids and starts (arrays: each segment's
    ident, and where it begins in that text's ids), id_bytes (int: of each id; 2 if the vocabulary and pad stay below
    65,536, else 4; positions have as many). A text longer than length is cut every length ids; its
    pieces in order of starts are its ids, none lost.

    Null or empty text: no tokens, so in no row. Null ident: null in doc_ids. Rows that repeat are packed each.
    Empty table: no rows. Other columns play no part. A length of over 65,535 takes 4 bytes as well. A buffer leaves
    its last rows partly filled: over buffers of BUFFER_TOKENS that is a row in about 2,000.
    """
    names = ["shard", "pack", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "starts", "id_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, made = TaskContext.get().partitionId(), 0
        code = tokenizer(path, pattern).encode_to_numpy
        width = id_width(path, length, pad)
        pieces: list[tuple] = []
        held = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal pieces, held, made
            rows = best_fit_decreasing([len(p[2]) for p in pieces], length)
            for at in range(0, len(rows), 512):
                some = rows[at : at + 512]
                ids, places = np.full((len(some), length), pad, width), np.zeros((len(some), length), width)
                ends = []
                for k, row in enumerate(some):
                    cut = [0]
                    for i in row:
                        a, b = cut[-1], cut[-1] + len(pieces[i][2])
                        ids[k, a:b], places[k, a:b] = pieces[i][2], count[: b - a]
                        cut.append(b)
                    ends.append(cut)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(some), pa.int32()), pa.array(range(made, made + len(some)), pa.int64()), pa.array([c[-1] for c in ends], pa.int32()),
                    pa.array([r.tobytes() for r in ids], pa.binary()), pa.array(ends, pa.list_(pa.int32())), pa.array([r.tobytes() for r in places], pa.binary()),
                    pa.array([[pieces[i][0] for i in row] for row in some], pa.list_(id_type)), pa.array([[pieces[i][1] for i in row] for row in some], pa.list_(pa.int32())), pa.repeat(pa.scalar(width.itemsize, pa.int32()), len(some)),
                ], names=names)
                made += len(some)
            pieces, held = [], 0

        count = np.arange(length, dtype=width)
        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            for own, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = code(t.as_py() or "", disallowed_special=()).astype(width)
                pieces.extend((own, a, ids[a : a + length]) for a in range(0, len(ids), length))
                held += len(ids)
                if held >= BUFFER_TOKENS:
                    yield from packed()
        if pieces:
            yield from packed()

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(F.col(ident), F.col(text)).mapInArrow(run, f"shard int, pack long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<{kind}>, starts array<int>, id_bytes int")


def write_packed(rows: DataFrame, path: str) -> None:
    """Write the packed rows as Parquet, a file for each task; a row's binary columns are lines of the matrices."""
    rows.write.parquet(path)


__all__ = ["LENGTH", "PAD", "VOCABULARY", "RoomTree", "best_fit_decreasing", "pack", "write_packed"]
