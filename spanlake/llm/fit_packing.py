"""Token ids packed by best-fit decreasing, with a segment tree for the search by capacity.

Each task packs blocks of a bounded number of ids by itself, so there is no shuffle and the memory of a task does not
grow with the corpus; within a block the fit is the global one of that block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import few_rows, raw, shared_folder
from .subwords import chunk_ids, default_path

LENGTH = 4096
#: Ids that a task holds at once: 1,024 sequences of 4,096.
BLOCK_IDS = 1 << 22
END_ID = 2


class CapacityTree:
    """A segment tree over the capacities 0..most; a leaf holds the open sequences with that many free places.

    ``best(n)`` finds the smallest capacity of at least n that has one, in O(log most)."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._add(capacity, 1)

    def best(self, need: int) -> tuple[int, int] | None:
        """Takes out (capacity, sequence) of the tightest fit; of equal ones, the one put last."""
        node = self.size + need
        if not self.count[node]:
            while node & 1 or not self.count[node + 1]:  # up, until a right neighbour has something
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Numbers of the pieces in each sequence; every size is from 1 to ``length``."""
    tree, out = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.best(sizes[i])
        if found is None:
            found = (length, len(out))
            out.append([])
        capacity, sequence = found
        out[sequence].append(i)
        if capacity > sizes[i]:
            tree.put(capacity - sizes[i], sequence)
    return out


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, pad_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row for each packed sequence: sequence_id, n_ids (without padding), ids (``length`` little-endian uint16),
    cu_seqlens (0 and the end of each segment), position_ids (uint16, from 0 again at each segment, 0 in the padding),
    doc_ids and starts (of each segment: its document and how many of its ids come before).

    Documents longer than ``length`` are cut into pieces that are all kept.  A null text counts as empty and still has
    its end id; an empty table gives no row.  The vocabulary must fit 16 bits.  Repeated rows are packed each for itself;
    a null doc_id stays null; other columns, whatever their names, are ignored.
    """
    if not 1 <= length <= 65_536:
        raise ValueError("length must be from 1 to 65536")
    path, tail = tokenizer or default_path(), np.array(end_id, "<u2").tobytes()

    def emit(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        fits = best_fit_decreasing([len(x[2]) // 2 for x in held], length)
        out: list[list] = [[], [], [], [], [], []]
        for members in fits:
            segments = [held[i] for i in members]
            ends = np.cumsum([len(x[2]) // 2 for x in segments])
            places = np.arange(length, dtype="<u2")
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                places[a:b] = np.arange(b - a)
            places[ends[-1] :] = 0
            ids = b"".join([x[2] for x in segments])
            ids += np.full(length - len(ids) // 2, pad_id, "<u2").tobytes()
            for column, value in zip(out, (int(ends[-1]), ids, [0, *ends.tolist()], places.tobytes(), [x[0] for x in segments], [x[1] for x in segments])):
                column.append(value)
        kinds = (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["n_ids", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = chunk_ids(path, "<u2"), [], 0
        if table.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("the vocabulary does not fit 16 bits")
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), raw(batch, "text")):
                ids = table.of(text) + tail
                for at in range(0, len(ids), 2 * length):
                    held.append((key, at // 2, ids[at : at + 2 * length]))
                n += len(ids) // 2
                if n >= block_ids:
                    yield emit(held)
                    held, n = [], 0
        if held:
            yield emit(held)

    few_rows(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(run, "n_ids int, ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, starts array<long>")
    return made.select(F.monotonically_increasing_id().alias("sequence_id"), "*")


def write_matrices(rows: DataFrame, path: str) -> DataFrame:
    """Writes packed sequences as Parquet, a fixed-width binary row each, and returns them as they were read back.

    ``matrix`` makes arrays of them.  A file that is there already is an error."""
    rows.write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def matrix(rows: list[bytes]) -> np.ndarray:
    """Rows of ids or of positions as one uint16 matrix, sequence by sequence."""
    return np.frombuffer(b"".join(rows), "<u2").reshape(len(rows), -1) if rows else np.zeros((0, 0), np.uint16)


def digests(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the matrices of ``docs`` below ``path`` (a new folder in the shared one, if None) and returns a row for each
    sequence that was read back, with the checksums of its id and position rows and all of its segments."""
    path = path or f"{shared_folder(docs.sparkSession)}/packed-{uuid.uuid4().hex}"
    return write_matrices(packed(docs, tokenizer), path).select(
        "sequence_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"), "cu_seqlens", "doc_ids", "starts"
    )
