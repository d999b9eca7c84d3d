"""Hard negatives by the threshold algorithm over shards of vectors.

Rows are dealt to shards of bounded size by a hash of their id.  A shard sorts its
rows once by every component; those are the candidate lists.  For an anchor the
lists are read from the end that its component's sign prefers, every row met for
the first time is scored whole (random access), and what no list has shown yet can
score at most the sum of the anchor's components times those last read.  Reading
stops once that threshold falls strictly below the kth score of every window, so
ties are never lost.  Best rows of all shards meet in a ranked window whose limit
Spark applies before the shuffle.

The first pass finds each anchor's positives among its label, the second, with a
window of scores for every positive, its negatives among the other labels.
Anchors meet shards in blocks: both sides of a task are bounded, whatever the
number of rows, and no table is broadcast or collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskframe.llm.store import stage

#: Rows of a shard, and anchors that a task takes at a time, on average.
SHARD_ROWS = 2_048
BLOCK_ANCHORS = 4_096
#: Entries of every list that the first step reads; each later step reads twice as many.
FIRST_STEP = 8
_LONG = 1 << 63


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``embedding`` of the rows that take part, as long, long and doubles.

    Nulls in any of them, and null or non-finite components, keep a row out.
    """
    made = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return made.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)


def _once(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, labels and vectors, each id once: the least label, then the least vector."""
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    column = rows["embedding"].combine_chunks()
    flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy()
    offsets = offsets - offsets[0] if len(offsets) else offsets
    vectors = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    keep = np.arange(len(ids))
    if len(np.unique(ids)) < len(ids):
        keep = np.array(sorted(keep, key=lambda i: (ids[i], labels[i], vectors[i].tolist())))
        first = np.ones(len(keep), dtype=bool)
        first[1:] = ids[keep][1:] != ids[keep][:-1]
        keep = keep[first]
    return ids[keep], labels[keep], [vectors[i] for i in keep]


def _whole(vectors: list[np.ndarray], scale: float) -> np.ndarray:
    """floor(scale * x) of all components, as exact whole numbers."""
    return np.floor(scale * np.array(vectors, dtype=np.float64).reshape(len(vectors), -1))


def _exact(anchors: np.ndarray, rows: np.ndarray) -> type:
    """The number type in which every inner product of the two, and every partial sum, is exact."""
    width = rows.shape[1]
    most = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(width, 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def _as_type(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape) if kind is object else x.astype(kind)


class Lists:
    """Rows of one shard with their positions in the order of every component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.labels, self.rows = ids, labels, rows
        self.order = np.argsort(rows, axis=0, kind="stable").T if rows.dtype != object else np.array([sorted(range(len(ids)), key=list(c).__getitem__) for c in rows.T], dtype=np.int64).reshape(rows.shape[::-1])
        self.sorted = np.take_along_axis(rows.T, self.order, axis=1)

    def best(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions and scores of the first k allowed rows of every window (least, greatest score), ties by id."""
        n = len(self.ids)
        found = [(np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)) for _ in windows]
        if not n:
            return found
        signs = np.sign(anchor).astype(np.int64)
        up, down = np.flatnonzero(signs < 0), np.flatnonzero(signs > 0)
        seen, marked = ~allowed, np.zeros(n, dtype=bool)
        at, step = 0, FIRST_STEP
        while True:
            to = min(at + step, n)
            if len(up) or len(down):
                marked[self.order[up, at:to]] = True
                marked[self.order[down, n - to : n - at]] = True
                new = np.flatnonzero(marked & ~seen)
                limit = anchor[up] @ self.sorted[up, to - 1] + anchor[down] @ self.sorted[down, n - to]
            else:  # every score is 0
                new, to, limit = np.flatnonzero(~seen), n, 0
            seen[new] = True
            if len(new):
                scores = self.rows[new] @ anchor
                for w, (lo, hi) in enumerate(windows):
                    old, had = found[w]
                    floor = had[-1] if len(old) == k else lo
                    fits = (scores >= floor) & (scores <= hi)
                    if fits.any():
                        places, values = np.concatenate((old, new[fits])), np.concatenate((had, scores[fits]))
                        first = np.lexsort((self.ids[places], -values))[:k] if values.dtype != object else np.array(sorted(range(len(places)), key=lambda i: (-values[i], self.ids[places[i]]))[:k])
                        found[w] = places[first], values[first]
            if to == n or seen.all() or all(limit < (had[-1] if len(old) == k else lo) or lo > hi for (old, had), (lo, hi) in zip(found, windows, strict=True)):
                return found
            at, step = to, 2 * step


FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("found_id", pa.int64()), ("score", pa.int64())])


def _search(rows: pa.Table, anchors: pa.Table, scale: float, k: int, same: bool) -> pa.Table:
    """The first k rows of a shard for every window of every anchor of a block."""
    out: list[tuple[int, int, int, int]] = []
    if rows.num_rows and anchors.num_rows:
        ids, labels, vectors = _once(rows)
        widths = np.array([len(v) for v in vectors])
        a_ids, a_labels = anchors["anchor_id"].to_pylist(), anchors["label"].to_pylist()
        a_vectors = [np.array(v, dtype=np.float64) for v in anchors["embedding"].to_pylist()]
        a_windows = [[(w["slot"], w["lo"], w["hi"]) for w in ws] for ws in anchors["windows"].to_pylist()]
        for width in sorted({len(v) for v in a_vectors} & set(widths.tolist())):
            held = np.flatnonzero(widths == width)
            whole = _whole([vectors[i] for i in held], scale)
            asked = [i for i, v in enumerate(a_vectors) if len(v) == width]
            a_whole = _whole([a_vectors[i] for i in asked], scale)
            kind = _exact(a_whole, whole)
            whole, a_whole = _as_type(whole, kind), _as_type(a_whole, kind)
            here_ids, here_labels = ids[held], labels[held]
            parts = {label: here_labels == label for label in {a_labels[i] for i in asked}} if same else {None: np.ones(len(held), dtype=bool)}
            lists_of = {key: Lists(here_ids[m], here_labels[m], whole[m]) for key, m in parts.items()}
            for i, anchor in zip(asked, a_whole, strict=True):
                windows = [(lo if lo is not None else -math.inf, hi if hi is not None else math.inf) for _, lo, hi in a_windows[i]]
                lists = lists_of[a_labels[i] if same else None]
                allowed = lists.ids != a_ids[i] if same else lists.labels != a_labels[i]
                for (slot, _, _), (places, scores) in zip(a_windows[i], lists.best(anchor, allowed, windows, k), strict=True):
                    out += [(a_ids[i], slot, int(lists.ids[p]), max(-_LONG, min(_LONG - 1, int(s)))) for p, s in zip(places, scores, strict=True)]
    return pa.table([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, FOUND.types, strict=True)], schema=FOUND)


def _meet(rows: DataFrame, anchors: DataFrame, shards: int, blocks: int, scale: float, k: int, same: bool) -> DataFrame:
    """First k rows for every anchor and slot, over all shards: ``anchor_id``, ``slot``, ``rank``, ``found_id``, ``score``."""
    keys, parts = ["shard", "block"], 2 * shards * blocks

    def number(name: str, of: int, salt: int) -> Column:
        return F.pmod(F.xxhash64(name, F.lit(salt)), F.lit(of)).cast("int")

    def all_of(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    left = rows.withColumn("shard", number("vec_id", shards, 1)).withColumn("block", all_of(blocks)).repartition(parts, *keys)
    right = anchors.withColumn("block", number("anchor_id", blocks, 2)).withColumn("shard", all_of(shards)).repartition(parts, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _search(a, b, scale, k, same), "anchor_id long, slot int, found_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "found_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, lowest: int = 50, highest: int = 95, scale: float = 256.0) -> DataFrame:
    """For each anchor and each of its first positives, the first rows of other labels whose score is near the positive's.

    ``vectors`` has ``vec_id``, ``label`` and ``embedding``; ``is_anchor`` is a condition on
    ``vec_id``.  A component x counts as floor(scale * x), a score is the inner product,
    higher scores come first, ties by smaller id.  An anchor's positives are its first
    ``positives`` other rows of its label.  A negative's score is at least ``lowest`` and at
    most ``highest`` hundredths of the positive's.  Returns ``anchor_id``, ``positive_id``,
    ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    Rows with a null id or label, a null vector, or a null or non-finite component
    take no part.  Of rows that share an id the one with the least label, then the
    least vector counts.  Vectors of different lengths are never compared.  Scores
    are exact; where one does not fit a long, the nearest long is returned and such
    scores tie between shards.  Other columns are left out; no rows give no rows.
    """
    rows = usable(vectors)
    total = rows.agg(F.count("*").alias("n"), F.count(F.when(is_anchor, 1)).alias("asked")).first()
    shards, blocks = max(1, -(-total.n // SHARD_ROWS)), max(1, -(-total.asked // BLOCK_ANCHORS))
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
    anchors = anchors.select(F.col("vec_id").alias("anchor_id"), F.col("row.label").alias("label"), F.col("row.embedding").alias("embedding"))
    anything = F.array(F.struct(F.lit(0).alias("slot"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")))
    first = stage(_meet(rows, anchors.withColumn("windows", anything), shards, blocks, scale, positives, True), "positives")
    first = first.select("anchor_id", F.col("rank").cast("int").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # 100 * score >= lowest * positive and 100 * score <= highest * positive, without leaving whole numbers
    wide = F.col("positive_score").cast("decimal(20,0)")
    lo = -F.floor(-wide * lowest / 100).cast("decimal(25,0)")
    hi = F.floor(wide * highest / 100).cast("decimal(25,0)")
    window = first.withColumn("lo", lo.cast("long")).withColumn("hi", hi.cast("long")).where("lo <= hi")
    windows = window.groupBy("anchor_id").agg(F.collect_list(F.struct("slot", "lo", "hi")).alias("windows"))
    asked = anchors.join(windows, "anchor_id")
    near = _meet(rows, asked, shards, blocks, scale, negatives, False)
    return near.join(first, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def with_moved_labels(vectors: DataFrame) -> DataFrame:
    """The table with label (label + 1) % 10 where ``vec_id`` is divisible by 7."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
