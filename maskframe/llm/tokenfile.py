"""Token files: ids ranked by frequency, in byte-aligned variable length with separate control bytes.

A file's ranks 0, 1, … are the ids from the most to the least frequent one (ties:
smaller id first), so that the commonest 256 ids take one byte.  Values are
coded in fours: a control byte holds four times two bits, each the number of
bytes less one, the lowest bits first; the bytes themselves, little-endian, stand
in a run of their own.  The last four of a document are filled up with one-byte
zeros.

On disk a file is a folder of Parquet parts, in ascending ``doc_id``, with one row
for each block of whole documents: ``part``, ``block``, ``start`` (ids before it in
its part), ``doc_ids``, ``lengths``, ``control``, ``data``.  Beside it lies ``ranks`` (rank,
id, n), at most one row for each id of the vocabulary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.store import binary, by_columns, ids_and_texts, stage
from maskframe.llm.tokens import encoder
from maskframe.llm.words import ranges
from maskframe.sources.sinks import work_dir

#: Ids in a block, apart from single longer documents.
BLOCK = 1 << 16
_BYTES = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], dtype=np.uint8)
_TOTAL = _BYTES.sum(axis=1, dtype=np.int64)


def encode(values: np.ndarray, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of runs of unsigned 32-bit values, and the number of data bytes of each run."""
    lengths = np.array([len(values)]) if lengths is None else lengths
    whole = -(-lengths // 4) * 4
    filled = np.zeros(int(whole.sum()), dtype="<u4")
    filled[ranges(np.cumsum(whole) - whole, lengths)] = values
    size = (filled > 0xFF).astype(np.uint8) + (filled > 0xFFFF) + (filled > 0xFFFFFF)
    control = size.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    data = filled.view(np.uint8).reshape(-1, 4)[np.arange(4) <= size[:, None]]
    before = np.concatenate(([0], np.cumsum(size, dtype=np.int64) + np.arange(1, len(size) + 1)))
    ends = np.cumsum(whole)
    return control.astype(np.uint8), data, before[ends] - before[ends - whole]


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first n values, by a table from control bytes to lengths."""
    sizes = _BYTES[np.frombuffer(control, np.uint8)].ravel()
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(sizes > k)
        if len(more):
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out[:n]


TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def id_type(vocabulary: str | None = None) -> str:
    """How ids are stored between steps: two bytes where the vocabulary allows it, else four, little-endian."""
    return "<u2" if encoder(vocabulary).size <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, end: int = 2, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (as ``id_type`` says) of every whole text, with ``end`` behind it.

    Null texts count as empty; repeated rows stay; other columns are left out.
    """

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kind = encoder(vocabulary), np.dtype(id_type(vocabulary))
        for batch in batches:
            for at, ids, bounds in coder.encode(batch.column(1), end):
                lengths = np.diff(bounds)
                yield pa.record_batch([batch.column(0).slice(at, len(lengths)), pa.array(lengths), binary(ids.astype(kind), lengths, kind.itemsize)], schema=TOKENS)

    return ids_and_texts(docs).mapInArrow(columns, "doc_id long, n_tokens long, ids binary")


CODED = pa.schema([("place", pa.int32()), ("doc_id", pa.int64()), ("length", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])
BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])


def write(tokens: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write token rows (``tokenize``; read twice, so stage them) as a token file.

    Documents are coded where they are and then sorted, so only what goes into
    the file is shuffled; the bounds of its parts come from the ids alone, so nothing
    is coded twice.  Rows with equal ``doc_id`` follow each other by their
    coded bytes; a null ``doc_id`` comes first.
    """
    kind = np.dtype(id_type(vocabulary))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=len(counts))
            more[: len(counts)] += counts
            counts = more
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # The vocabulary bounds what comes to the driver here.
    ranked = sorted(((r.id, r.n) for r in counts.collect()), key=lambda x: (-x[1], x[0]))
    spark = tokens.sparkSession
    spark.createDataFrame([(rank, i, n) for rank, (i, n) in enumerate(ranked)], "rank int, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max((i for i, _ in ranked), default=0) + 1, dtype=np.uint32)
    rank[[i for i, _ in ranked]] = np.arange(len(ranked))

    # One bound for each shuffle partition comes to the driver.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [k / parts for k in range(1, parts)]
    found = tokens.agg(F.percentile_approx("doc_id", steps, max(10_000, 10 * parts))).first()[0] if steps else None
    bounds = np.unique(np.array(found or [], np.int64))

    def coded(batch: pa.RecordBatch) -> list:
        lengths = batch.column(1).to_numpy()
        control, data, sizes = encode(rank[np.frombuffer(b"".join(batch.column(2).to_pylist()), kind)], lengths)
        place = np.searchsorted(bounds, batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(), side="right").astype(np.int32)
        return [place, batch.column(0), batch.column(1), binary(control, -(-lengths // 4), 1), binary(data, sizes, 1)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def full() -> pa.RecordBatch:
            docs, lengths, control, data = zip(*held, strict=True)
            return pa.record_batch([pa.array([x], type=t) for x, t in zip((part, block, start, docs, lengths, b"".join(control), b"".join(data)), BLOCKS.types, strict=True)], schema=BLOCKS)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size + row[1] > BLOCK:
                    yield full()
                    block, start, held, size = block + 1, start + size, [], 0
                held.append(row)
                size += row[1]
        if held:
            yield full()

    rows = tokens.select("doc_id", "n_tokens", "ids").mapInArrow(by_columns(coded, CODED), "place int, doc_id long, length long, control binary, data binary")
    rows = rows.repartitionById(parts, "place").drop("place").sortWithinPartitions("doc_id", "length", "control", "data")
    rows.mapInArrow(blocks, "part int, block int, start long, doc_ids array<long>, lengths array<long>, control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/blocks")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("ids", pa.binary())])


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a token file: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, ``part``, ``block`` and ``ids``."""
    ids = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], dtype="<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    before, total = {}, 0
    # One row for each part that was written.
    for r in blocks.groupBy("part").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n")).orderBy("part").collect():
        before[r.part], total = total, total + r.n

    def documents(batch: pa.RecordBatch) -> list:
        out = [[] for _ in READ]
        for part, block, start, docs, lengths, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = ids[decode(control, data, 4 * len(control))] if len(control) else ids[:0]
            at, first = before[part] + start, 0
            for doc, n in zip(docs, lengths, strict=True):
                raw = found[first : first + n].tobytes()
                for column, x in zip(out, (doc, at, n, zlib.crc32(raw), part, block, raw if with_ids else None), strict=True):
                    column.append(x)
                at, first = at + n, first + -(-n // 4) * 4
        return out

    return blocks.mapInArrow(by_columns(documents, READ), "doc_id long, start long, n_tokens long, ids_crc32 long, part int, block int, ids binary")


def round_trip(docs: DataFrame, end: int = 2) -> DataFrame:
    """Write the token file of all documents and read it back; a digest of each document's ids."""
    path = work_dir(docs.sparkSession, "tokenfile")
    write(stage(tokenize(docs, end), "tokens", compression="zstd"), path)
    return read(docs.sparkSession, path, with_ids=False).drop("ids")
