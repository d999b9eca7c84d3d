"""Periodic runs of words: stretches that repeat one unit at least four times, found through Lyndon roots.

A run is a maximal stretch of words with smallest period q and a length of at
least ``min_exponent`` q.  Under the order of words that makes the word after the
run smaller than the one a period before it (or under both, at the text's end),
every unit that is a Lyndon word is the longest Lyndon word that begins there.
So the longest Lyndon words of all positions under an order and its reverse hold
a unit of every run.  They come from grouping suffixes as the first phase of a
suffix sorter does: groups are taken from the largest down, and each member's
nearest smaller suffix to the left takes the member's word onto its own.  Each
unit is then extended to both sides as far as words a period apart are equal.

The grouping runs over the parts of a text that can hold a run at all.  In a run
of period q every word after the first q also stands at most q words before, so
at least (min_exponent - 1) q neighbouring words do.  Stretches where that holds
for q up to a power of two, with as many words before them, cover every run, and
ordinary prose has hardly any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.llm.words import texts, white_space, word_hashes


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each position of a sequence of numbers from 0 on.

    Groups hold the positions whose word so far is the same, in ascending order;
    ``below`` and ``above`` are their neighbours in the order of words.  ``left`` and
    ``right`` link the positions whose group is still to come, so the nearest
    position to the left in a smaller group is one look-up.
    """
    n, size = len(ranks), max(ranks, default=-1) + 1
    members: list[list[int]] = [[] for _ in range(size)]
    for i, r in enumerate(ranks):
        members[r].append(i)
    group, length = list(ranks), [1] * n
    left, right = list(range(-1, n)), [*range(1, n + 1), 0]  # place n stands for both ends
    below, above = list(range(-1, size)), [*range(1, size + 1), 0]
    members.append([])  # above all groups, and empty
    now = size - 1
    while now >= 0:
        moved: list[int] = []
        times: list[int] = []
        word = 0
        for i in members[now]:
            if group[i] != now:
                continue
            word = length[i]
            a, b = left[i], right[i]
            right[a], left[b] = b, a
            if a >= 0:
                if moved and moved[-1] == a:
                    times[-1] += 1
                else:
                    moved.append(a)
                    times.append(1)
        if len(moved) == 1:
            splits = [(times[0], moved)]
        else:
            by: dict[int, list[int]] = {}
            for a, k in zip(moved, times, strict=True):
                by.setdefault(k, []).append(a)
            splits = sorted(by.items(), reverse=True)
        for k, some in splits:
            made: dict[int, int] = {}
            for a in some:
                old = group[a]
                new = made.get(old)
                if new is None:
                    new = made[old] = len(members)
                    members.append([])
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    below[up] = new
                    above[old] = new
                members[new].append(a)
                group[a] = new
                length[a] += k * word
        now = below[now]
    return length


def _maximal(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every stretch of true values that stays between two neighbouring bounds."""
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[bounds] = True
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:-1]
    last[:-1] &= ~mask[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def suspects(hashes: np.ndarray, before: np.ndarray, min_exponent: int, min_length: int) -> list[tuple[int, int, int]]:
    """Text, start and end of separate parts that hold every run whole."""
    n = len(hashes)
    if not n:
        return []
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.argsort(hashes, kind="stable")
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    back = np.full(n, n, dtype=np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    cover, reach, longest = np.zeros(n + 1, dtype=np.int64), 1, int(np.diff(before).max())
    while True:
        least = reach // 2 + 1  # the smallest period of this level
        need = max((min_exponent - 1) * least, min_length - reach, 1)
        if need + least > longest:
            break
        start, end = _maximal(back <= reach, before)
        wide = end - start >= need
        if wide.any():
            start, end = start[wide], end[wide]
            np.add.at(cover, np.maximum(start - reach, before[text[start]]), 1)
            np.add.at(cover, end, -1)
        reach *= 2
    start, end = _maximal(np.cumsum(cover[:-1]) > 0, before)
    return list(zip(text[start].tolist(), start.tolist(), end.tolist(), strict=True))


def runs_of(hashes: np.ndarray, before: np.ndarray, min_exponent: int = 4, min_length: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (among all words), length and period of every run of each text, by text, start and period.

    ``hashes`` are the words of all texts, ``before`` the number of words before each text, with the total.
    """
    found: set[tuple[int, int, int]] = set()
    for text, a, b in suspects(hashes, before, min_exponent, min_length):
        lo, hi = int(before[text]), int(before[text + 1])
        words = np.unique(hashes[lo:hi], return_inverse=True)[1]
        ranks = np.unique(words[a - lo : b - lo], return_inverse=True)[1]
        at = np.concatenate([np.arange(b - a)] * 2)
        period = np.array(lyndon_array(ranks.tolist()) + lyndon_array((ranks.max() - ranks).tolist()))
        # one unit begins in the first period of a run, which has (min_exponent - 1) more
        ok = at + (min_exponent - 1) * period < b - a
        at, period = at[ok], period[ok]
        ok = ranks[at] == ranks[at + period]
        at, period = at[ok] + (a - lo), period[ok]
        for q in np.unique(period).tolist():
            units = np.unique(at[period == q])
            differs = np.flatnonzero(words[:-q] != words[q:])
            k = np.searchsorted(differs, units)
            start = np.where(k > 0, differs[np.maximum(k, 1) - 1] + 1, 0) if len(differs) else np.zeros(len(units), np.int64)
            end = np.where(k < len(differs), differs[np.minimum(k, len(differs) - 1)], len(words) - q) + q if len(differs) else np.full(len(units), len(words))
            long = end - start >= max(min_length, min_exponent * q)
            found.update((lo + s, e - s, q) for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True))
    out = np.array(sorted((s, q, length) for s, length, q in found), dtype=np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 2], out[:, 1]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
COLLAPSED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])
_SPACE = 0x20


def _joined(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, stays: np.ndarray) -> pa.Array:
    """The words of each text that stay, joined by one space."""
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[starts[stays]] += 1
    edge[ends[stays]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))[stays]
    more = np.zeros(len(text), dtype=bool)
    more[:-1] = text[1:] == text[:-1]
    gaps = ends[stays][more]  # a later word of the text follows, so white space does
    mask[gaps] = True
    data = data.copy()
    data[gaps] = _SPACE
    sizes = np.concatenate(([0], np.cumsum(mask)))[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[mask])).cast(pa.string())


def collapse(docs: DataFrame, min_exponent: int = 4, min_length: int = 6) -> DataFrame:
    """Runs of the words ``[^\\x20\\x09-\\x0D]+`` of every whole text, and the text with one unit of each.

    Returns for every row ``doc_id`` (null stays null), ``n_words``, ``runs`` (start and
    length in words, numbered from 0, and smallest period; by start, then period)
    and ``collapsed``: the words that are in no run behind its first period, joined by
    one space.  Null and empty texts have no words.  Repeated ids are rows of their
    own.  Other columns are left out.  No row meets another, so there is no shuffle.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, before, offsets, (data, starts, ends) in word_hashes(batch.column(1), white_space()):
                start, length, period = runs_of(hashes, before, min_exponent, min_length)
                edge = np.zeros(len(hashes) + 1, dtype=np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                stays = np.cumsum(edge)[:-1] <= 0
                bounds = np.searchsorted(start, before)
                text = np.searchsorted(before, start, side="right") - 1
                runs = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([start - before[text], length, period], fields=list(RUN)))
                ids = batch.column(0).slice(at, len(before) - 1)
                yield pa.record_batch([ids, pa.array(np.diff(before)), runs, _joined(data, offsets, starts, ends, before, stays)], schema=COLLAPSED)

    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return held.mapInArrow(rows, "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where a tenth of the ids have a tail that repeats itself.

    With h = crc32 of the decimal ``doc_id`` and g = floor(h / 10): if h % 10 = 0, each
    word from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    Such texts are joined by one space; all others, and rows without an id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(1).to_pylist()
            marks = batch.column(2).to_pylist()
            for k, g in enumerate(marks):
                if g is None or not said[k]:
                    continue
                data, offsets = texts(pa.array([said[k]]))
                raw = data.tobytes()
                _, _, before, _, (_, starts, ends) = next(word_hashes(pa.array([said[k]]), white_space()))
                n = int(before[-1])
                if not n:
                    continue
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
                words = [raw[spans[i if i < a else a + (i - a) % p][0] : spans[i if i < a else a + (i - a) % p][1]] for i in range(n)]
                said[k] = b" ".join(words).decode()
            yield pa.record_batch([batch.column(0), pa.array(said, type=pa.string())], names=["doc_id", "text"])

    g = F.when(h % 10 == 0, F.floor(h / 10).cast("long"))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), g.alias("g")).mapInArrow(rows, "doc_id long, text string")


def digests(collapsed: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period), and digests of runs and of what stays."""
    runs = F.col("runs")
    best = F.element_at(F.array_sort(F.transform(runs, lambda r: F.struct((-r.length).alias("a"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length")))), 1)
    listed = F.concat_ws("", F.transform(runs, lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))))

    def of_best(name: str) -> Column:
        return F.when(F.size(runs) > 0, best[name])

    return collapsed.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        of_best("start").alias("start"),
        of_best("length").alias("length"),
        of_best("period").alias("period"),
        F.floor(1000 * of_best("length") / of_best("period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
