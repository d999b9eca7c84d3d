"""Packing documents into sequences of a fixed number of tokens by the sum-of-squares rule.

A piece goes where the sum over all gaps of the squared number of open sequences
with that gap becomes smallest.  Pieces are dealt at random into slots of a
bounded number of pieces, and each slot is packed by one task; when a slot is
through, the pieces of its open sequences are placed once more, longest first, each
into the open sequence that it fills best.  A slot then leaves a few dozen
sequences short of full, whatever the number of slots.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.store import ids_and_texts, stage
from maskframe.llm.tokenfile import id_type
from maskframe.llm.tokens import encoder

#: Pieces that one task packs, about.
SLOT = 100_000


def piece_lengths(n: int, size: int) -> list[int]:
    """Lengths of a document's pieces: only the first one of a longer document may be shorter than ``size``."""
    first = n % size or min(n, size)
    return [first] + [size] * ((n - first) // size)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed one after the other."""
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    count = np.zeros(size + 1, np.int64)  # open bins by level
    open_bins: list[list[int]] = [[] for _ in range(size)]
    for i, n in enumerate(lengths.tolist()):
        level = 0
        if n < size:
            here, there = count[1 : size - n + 1], count[n + 1 : size + 1]
            change = np.where(here > 0, 2 * (there - here) + 2, 2 * count[n] + 1)  # of the sum; a new bin adds 2 count + 1
            change[-1] = change[-1] if not here[-1] else 1 - 2 * here[-1]  # a full bin has no gap
            best = int(change.argmin())
            level = best + 1 if here[best] and change[best] < 2 * count[n] + 1 else 0
        if level:
            count[level] -= 1
            b = open_bins[level].pop()
        else:
            b, used = used, used + 1
        bins[i], offsets[i] = b, level
        if level + n < size:
            count[level + n] += 1
            open_bins[level + n].append(b)
    again = np.flatnonzero(np.isin(bins, [b for level in open_bins for b in level]))
    if len(again):
        bins[again], offsets[again] = best_fit(lengths[again], size)
        bins[again] += used
        bins = np.unique(bins, return_inverse=True)[1]
    return bins, offsets


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed longest first where the least room is left."""
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    some = np.zeros(size + 1, dtype=bool)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some[: size - n + 1][::-1]
        level = size - n - int(fits.argmax()) if fits.any() else 0
        if level:
            b = open_bins[level].pop()
            some[level] = bool(open_bins[level])
        else:
            b, used = used, used + 1
        bins[i], offsets[i] = b, level
        open_bins[level + n].append(b)
        some[level + n] = level + n < size
    return bins, offsets


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])


def pieces(docs: DataFrame, size: int = 1024, end: int = 2, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every whole document: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``row`` (crc of all its ids)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            for at, ids, bounds in coder.encode(batch.column(1), end):
                raw, out = memoryview(ids.astype("<u4").tobytes()), []
                for doc, a, b in zip(batch.column(0).slice(at, len(bounds) - 1).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    row, start = zlib.crc32(raw[4 * a : 4 * b]), 0
                    for k, n in enumerate(piece_lengths(b - a, size)):
                        out.append((doc, k, start, n, zlib.crc32(raw[4 * (a + start) : 4 * (a + start + n)]), row))
                        start += n
                yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), PIECES.types, strict=True)], schema=PIECES)

    return ids_and_texts(docs).mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def pack(docs: DataFrame, size: int = 1024, end: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Place all documents: one row per piece with ``sequence_id`` and ``offset``.

    Null texts are empty documents of one token (the end id).  Repeated rows are
    packed as often as they occur.  Deterministic: a slot's pieces are placed in
    the order of a hash of what they are.
    """
    cut = stage(pieces(docs, size, end, vocabulary), "pieces")
    slots = max(1, -(-cut.count() // SLOT))
    dealt = F.xxhash64("doc_id", "piece", "row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rows = [b for b in batches if b.num_rows]
        if not all_rows:
            return
        t = pa.Table.from_batches(all_rows).combine_chunks()
        slot, length = t["slot"].to_numpy(), t["length"].to_numpy()
        for a, b in zip(*(lambda x: (x, [*x[1:], len(slot)]))(np.flatnonzero(np.diff(slot, prepend=-1))), strict=True):
            bins, offsets = sum_of_squares(length[a:b], size)
            kept = t.slice(a, b - a).select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield from kept.append_column("sequence_id", pa.array((int(slot[a]) << 32) + bins)).append_column("offset", pa.array(offsets)).to_batches()

    rows = cut.withColumn("dealt", dealt).withColumn("slot", F.pmod(F.col("dealt"), F.lit(slots)).cast("long"))
    rows = rows.repartition(slots, "slot").sortWithinPartitions("slot", "dealt", "doc_id", "piece", "ids_crc32")
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def sequences(placed: DataFrame, tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids`` (as ``tokenfile.id_type`` says), ``doc_ids``; a sequence has at most ``size`` pieces.

    ``tokens`` has ``doc_id`` (unique) and ``ids`` (``tokenfile.tokenize``).
    """
    wide = np.dtype(id_type(vocabulary)).itemsize
    part = F.expr(f"substring(ids, cast(start * {wide} + 1 as int), cast(length * {wide} as int))")
    row = placed.join(tokens.select("doc_id", "ids"), "doc_id").select("sequence_id", F.struct("offset", "doc_id", part.alias("ids")).alias("p"))
    held = row.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return held.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
