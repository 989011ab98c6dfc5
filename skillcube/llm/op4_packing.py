"""Best-fit packing in bounded space: each piece goes to the open bin that it fills best.

Open bins are keyed by free space in a bitset (bit f: a bin with f free tokens is open), so the
tightest bin is one shift and one lowest-bit away. At `open_bins` the fullest bin closes first.
Rows are dealt evenly (round robin) to as few packing tasks as CHARS_PER_GROUP characters of text for each allow, since each
task leaves its last bins part-filled; a task streams and holds no more than its open bins.
Null texts are empty: the separator alone. Very long texts are cut into pieces of the capacity. Rows with equal or null ids are packed
each, equal pieces in the order they come. Extra columns are left aside. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, trim
from .tokens import RUN_CACHE, encoder

CAPACITY = 2048
SEPARATOR = 0
OPEN_BINS = 1024
CHARS_PER_GROUP = 256_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


class OpenBins:
    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.free: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def put(self, need: int) -> tuple[int, int]:
        """Bin number and offset for a piece of `need` tokens (1 to capacity)."""
        fit = self.bits >> need
        if fit:
            space = need + (fit & -fit).bit_length() - 1
            bin_ = self._pop(space)
        else:
            if need < self.capacity and self.open >= self.limit:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            bin_, space = self.made, self.capacity
            self.made += 1
        if space > need:
            self.free[space - need].append(bin_)
            self.bits |= 1 << (space - need)
            self.open += 1
        return bin_, self.capacity - space

    def _pop(self, space: int) -> int:
        stack = self.free[space]
        bin_ = stack.pop()
        if not stack:
            self.bits &= ~(1 << space)
        self.open -= 1
        return bin_


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = True, runs: int = RUN_CACHE, narrow: bool = False) -> DataFrame:
    """A row per piece; `ids`: little-endian unsigned 32-bit ids (null without keep_ids; narrow: of 16 bits, if the vocabulary allows)."""

    def cut(batches):
        enc = encoder(tokenizer, runs)
        end = np.array([separator], enc.dtype).tobytes()
        for batch in slices(batches):
            rows = []
            for k, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = np.frombuffer(enc.encode(t.as_py()) + end, enc.dtype).astype("<u4")
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    raw = part.tobytes()
                    kept = (part.astype(enc.dtype).tobytes() if narrow else raw) if keep_ids else None
                    rows.append((k, p, at, len(part), zlib.crc32(raw), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)
        trim()

    NAMES = [f.split()[0] for f in PIECE.split(", ")]
    TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECE)


def _wide(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with `ids` of 32 bits, from 16."""
    raw = (None if x is None else x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, n in zip(batch["ids"].to_pylist(), batch["length"].to_pylist()))
    return batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array(raw, pa.binary()))


def pack(items: DataFrame, groups: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, wide: bool = False) -> DataFrame:
    """Adds sequence_id and offset. items: any columns, with `length` from 1 to capacity; wide: narrow `ids` become those of 32 bits."""

    def place(batches):
        from pyspark import TaskContext

        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            put = [bins.put(n) for n in batch["length"].to_pylist()]
            batch = _wide(batch) if wide else batch
            arrays = [*batch.columns, pa.array([base + b for b, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.drop("sequence_id", "offset").schema)
    return items.drop("sequence_id", "offset").repartition(groups).mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, keep_ids: bool = True, chars_per_group: int = CHARS_PER_GROUP, runs: int = RUN_CACHE) -> DataFrame:
    chars = docs.agg(F.sum(F.char_length(F.col("text").cast("string")) + 1)).first()[0] or 0
    cut = pieces(docs, tokenizer, keep_ids=keep_ids, runs=runs, narrow=keep_ids)  # the shuffle moves half the bytes
    return pack(cut, max(1, math.ceil(chars / chars_per_group)), wide=keep_ids)


def query(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")
