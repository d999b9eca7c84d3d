"""Removal of repeated passages: every word in a window of 20 words that also starts earlier.

1. *Confirm.*  Of the 8-word phrases in a window the one with the smallest hash
   stands for the window, so equal windows are represented by equal phrases.  A row
   for each such phrase carries the hashes of the windows it stands for; rows meet
   by phrase, and the windows that occur more than once are confirmed with the
   place where each starts first.  Rows that agree in everything are combined
   before they are shuffled, chunk by chunk.  A phrase that very many documents
   share stands in different windows in each of them, where its surroundings
   differ; the commonest phrases, found in a sample of the documents, therefore send
   a row for each window, which meet by window.  So what meets under one key is
   either few rows, or windows equal in all chunks, one row for each chunk.
2. *Compile.*  Consecutive confirmed windows that first occur consecutively in one
   document form a passage.  The passages of each chunk of documents become an
   Aho-Corasick automaton.
3. *Stream.*  All documents of the chunk run through it; each place where a passage
   occurs, other than its first, goes.  The join has given all these places already,
   as the chunk's passages are those found in its own documents.

Hashes of windows have 64 bits for the phrase and 40 more for the window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.store import ids_and_texts
from maskframe.llm.words import mix, ranges, white_space, window_hashes, word_hashes

PHRASE = 8
#: Bytes of text whose equal phrases are combined before they are shuffled.
CHUNK_BYTES = 2 << 20

#: A phrase is common if so many documents of a sample, one in SAMPLED, have it; and how many of them, the commonest, are told to all tasks.
COMMON, SAMPLED, MOST_COMMON = 24, 64, 100_000
#: Rows that are confirmed at a time, apart from those of one key.
HELD_ROWS = 50_000

CANDIDATES = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("windows", pa.binary()), ("first_doc", pa.int64()), ("first_at", pa.int32())])
_CANDIDATES = "key long, doc_id long, at int, windows binary, first_doc long, first_at int"


def _smallest(hashes: np.ndarray, wide: int) -> np.ndarray:
    """Index of the smallest of each ``wide`` neighbours (ties: the leftmost)."""
    n = len(hashes) - wide + 1
    value, where, reach = hashes, np.arange(len(hashes)), 1
    while reach < wide:
        step = min(reach, wide - reach)
        left = value[:-step] <= value[step:]
        value, where = np.where(left, value[:-step], value[step:]), np.where(left, where[:-step], where[step:])
        reach += step
    return where[:n]


def _short(hashes: np.ndarray) -> np.ndarray:
    """40 bits of each hash, as rows of five bytes."""
    return np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]


def _represented(docs: np.ndarray, hashes: np.ndarray, before: np.ndarray, window: int) -> tuple | None:
    """Runs of windows with one representative: key, doc, first window, number of windows, and all windows' hashes in order."""
    found, offsets = window_hashes(hashes, before, window)
    if not len(found):
        return None
    phrases, phrase_before = window_hashes(hashes, before, PHRASE)
    wide = window - PHRASE + 1
    text = np.repeat(np.arange(len(docs)), np.diff(offsets))
    at = np.arange(len(found)) - offsets[:-1][text]
    where = _smallest(phrases, wide)[phrase_before[:-1][text] + at]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (where[1:] != where[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    return phrases[where[run]], docs[text[run]], at[run], np.diff(run, append=len(found)), found


def _by_window(found: tuple, common: np.ndarray) -> tuple:
    """Runs of windows whose phrase is common become runs of one window, with the window as their key."""
    key, doc, start, n, all_windows = found
    hot = np.isin(key, common)
    if not hot.any():
        return found
    parts = np.where(hot, n, 1)
    run, step = np.repeat(np.arange(len(n)), parts), ranges(np.zeros(len(n), np.int64), parts)
    at = (np.cumsum(n) - n)[run] + step
    own = mix(all_windows[np.minimum(at, len(all_windows) - 1)] ^ np.uint64(0x6A09E667F3BCC909))
    return np.where(hot[run], own, key[run]), doc[run], start[run] + step, np.where(hot[run], 1, n[run]), all_windows


def common_phrases(docs: DataFrame, window: int) -> np.ndarray:
    """The representative phrases that most documents share, sorted; at most ``MOST_COMMON``, from a sample of the documents.

    Which they are bears on how rows meet, not on what is found.
    """
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SAMPLED)) == 0)
    often = candidates(sample, window, combined=False).groupBy("key").count().where(F.col("count") >= COMMON)
    found = often.orderBy(F.desc("count"), "key").limit(MOST_COMMON).select("key").toArrow()["key"]
    return np.sort(found.to_numpy().astype(np.int64).view(np.uint64))


def candidates(docs: DataFrame, window: int, common: np.ndarray | None = None, combined: bool = True) -> DataFrame:
    """A row for each representative phrase, or window of a ``common`` one.

    Rows that are already known to repeat others say so in ``first_doc`` and
    ``first_at`` and have the number of their windows as ``key``.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, hashes, before, _, _ in word_hashes(batch.column(1), white_space(), chunk=CHUNK_BYTES):
                found = _represented(ids[at : at + len(before) - 1], hashes, before, window)
                if found is None:
                    continue
                if not combined:
                    key = found[0].view(np.int64)
                    none = pa.nulls(len(key), pa.int64())
                    yield pa.record_batch([pa.array(key), pa.array(found[1]), pa.array(found[2].astype(np.int32)), pa.nulls(len(key), pa.binary()), none, pa.nulls(len(key), pa.int32())], schema=CANDIDATES)
                    continue
                key, doc, start, n, all_windows = found if common is None else _by_window(found, common)
                # Equal rows of a chunk: the first stays, for the others it is known that they are repeats.
                whole = np.add.reduceat(mix(all_windows + ranges(np.zeros(len(n), np.int64), n).astype(np.uint64)), np.cumsum(n) - n) ^ mix(key + n.astype(np.uint64))
                order = np.lexsort((start, doc, whole))
                same = np.zeros(len(order), dtype=bool)
                same[1:] = whole[order][1:] == whole[order][:-1]
                leader = np.empty(len(order), np.int64)
                leader[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                repeat = np.zeros(len(order), dtype=bool)
                repeat[order] = same
                kept = ~repeat
                lengths = np.where(kept, n, 0)
                data = _short(all_windows[np.repeat(kept, n)])
                offsets = np.concatenate(([0], np.cumsum(lengths * 5))).astype(np.int32)
                windows = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
                key = np.where(kept, key.view(np.int64), n)
                yield pa.record_batch([pa.array(key), pa.array(doc), pa.array(start.astype(np.int32)), windows, pa.array(doc[leader], mask=kept), pa.array(start[leader].astype(np.int32), mask=kept)], schema=CANDIDATES)

    return docs.mapInArrow(rows, _CANDIDATES)


REPEATS = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("first_doc", pa.int64()), ("first_at", pa.int32())])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that start earlier elsewhere, with that place; rows come sorted by key, and some keys are held at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        known = t["first_doc"].is_valid()
        if pc.any(known).as_py():
            first = t.filter(known)
            yield pa.record_batch([first["doc_id"].combine_chunks(), first["at"].combine_chunks(), first["key"].cast(pa.int32()).combine_chunks(), first["first_doc"].combine_chunks(), first["first_at"].combine_chunks()], schema=REPEATS)
            t = t.filter(pc.invert(known))
        if not len(t):
            continue
        # All but the last key of what has come are whole.
        key = t["key"].to_numpy()
        whole = int(np.searchsorted(key, key[-1]))
        if held and whole == 0 and held[-1]["key"][-1].as_py() != key[0]:
            yield from _repeats_of(held)
            held = []
        held.append(t)
        if whole and sum(map(len, held)) >= HELD_ROWS:
            yield from _repeats_of([*held[:-1], t.slice(0, whole)])
            held = [t.slice(whole)]
    yield from _repeats_of(held)


def _repeats_of(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """The repeats among rows that have all rows of their keys."""
    if not tables:
        return
    t = pa.concat_tables(tables).combine_chunks()
    key, doc, at = t["key"].to_numpy(), t["doc_id"].to_numpy(), t["at"].to_numpy()
    column = t["windows"].combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    # Only keys with more than one row.
    twin = np.zeros(len(key), dtype=bool)
    twin[1:] = key[1:] == key[:-1]
    twin[:-1] |= twin[1:]
    mine = np.flatnonzero(twin)
    if not len(mine):
        return
    n = (offsets[mine + 1] - offsets[mine]) // 5
    row = np.repeat(mine, n)
    step = ranges(np.zeros(len(n), np.int64), n)
    raw = np.zeros((len(row), 8), np.uint8)
    raw[:, :5] = data[ranges(offsets[mine], n * 5)].reshape(-1, 5)
    window = mix(raw.view("<u8").ravel()) ^ key[row].view(np.uint64)
    start = at[row] + step
    order = np.lexsort((start, doc[row], window))
    new = np.ones(len(order), dtype=bool)
    new[1:] = window[order][1:] != window[order][:-1]
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    repeat = np.flatnonzero(first != np.arange(len(order)))
    if not len(repeat):
        return
    origin = first[repeat]
    r_row, r_at, f_doc, f_at = row[repeat], start[repeat], doc[row[origin]], start[origin]
    cut = np.ones(len(repeat), dtype=bool)
    cut[1:] = (r_row[1:] != r_row[:-1]) | (r_at[1:] != r_at[:-1] + 1) | (f_doc[1:] != f_doc[:-1]) | (f_at[1:] != f_at[:-1] + 1)
    run = np.flatnonzero(cut)
    yield pa.record_batch([pa.array(doc[r_row[run]]), pa.array(r_at[run].astype(np.int32)), pa.array(np.diff(run, append=len(repeat)).astype(np.int32)), pa.array(f_doc[run]), pa.array(f_at[run].astype(np.int32))], schema=REPEATS)


def repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """``doc_id``, ``at``, ``n``, ``first_doc``, ``first_at``: n windows from word ``at`` on also start at ``first_at`` of ``first_doc``, which is earlier.

    The first place of a row that was combined before the shuffle is an earlier
    one, but not always the earliest.
    """
    rows = candidates(docs, window, common_phrases(docs, window))
    dealt = F.when(F.col("first_doc").isNull(), F.col("key")).otherwise(F.xxhash64("doc_id", "at"))
    dealt_rows = rows.withColumn("dealt", dealt).repartition("dealt").sortWithinPartitions("key")
    return dealt_rows.select(*CANDIDATES.names).mapInArrow(_confirmed, "doc_id long, at int, n int, first_doc long, first_at int")


def _letters(codes: np.ndarray) -> str:
    """Three letters for each code, each from a range of its own, so that no match can begin inside a word."""
    base = int(codes.max() ** (1 / 3)) + 2
    spelled = np.stack([codes // base**2, codes // base % base + base, codes % base + 2 * base], axis=1)
    return (spelled + 0x100).astype("<u2").tobytes().decode("utf-16-le")


def passages(runs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Runs (text, at, n, first_doc, first_at) that follow each other here and where they occur first, as one."""
    text, at, n, first_doc, first_at = (x[np.lexsort((runs[1], runs[0]))] for x in runs)
    new = np.ones(len(at), dtype=bool)
    ends = at + n
    new[1:] = (text[1:] != text[:-1]) | (at[1:] != ends[:-1]) | (first_doc[1:] != first_doc[:-1]) | (first_at[1:] != (first_at + n)[:-1])
    start = np.flatnonzero(new)
    return text[start], at[start], np.add.reduceat(n, start), first_doc[start], first_at[start]


def locate(docs: np.ndarray, hashes: np.ndarray, before: np.ndarray, runs: tuple[np.ndarray, ...], window: int) -> np.ndarray:
    """Whether each word of a shard's documents goes.

    ``runs``: text, at, n, first_doc, first_at of confirmed windows of these texts.  Each
    distinct passage of n + window - 1 words goes into the automaton, which reads
    every text.
    """
    gone = np.zeros(len(hashes), dtype=bool)
    if not len(runs[0]):
        return gone
    spelled = _letters(np.unique(hashes, return_inverse=True)[1].astype(np.int64))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    number: dict[str, int] = {}
    earliest: list[tuple[int, int]] = []
    lengths: list[int] = []
    text, at, n, first_doc, first_at = passages(runs)
    start = before[text] + at
    for a, b, doc, place in zip((3 * start).tolist(), (3 * (start + n + window - 1)).tolist(), first_doc.tolist(), first_at.tolist(), strict=True):
        passage = spelled[a:b]
        k = number.setdefault(passage, len(earliest))
        if k == len(earliest):
            automaton.add_word(passage, k)
            earliest.append((doc, place))
            lengths.append(b - a)
        elif (doc, place) < earliest[k]:
            earliest[k] = (doc, place)
    automaton.make_automaton()
    spans = []
    for doc, a, b in zip(docs.tolist(), before[:-1].tolist(), before[1:].tolist(), strict=True):
        for end, k in automaton.iter(spelled[3 * a : 3 * b]):
            first = (end + 1 - lengths[k]) // 3
            if (doc, first) > earliest[k]:
                spans.append((a + first, a + (end + 1) // 3))
    if spans:
        edge = np.zeros(len(hashes) + 1, np.int64)
        first, last = np.array(spans).T
        np.add.at(edge, first, 1)
        np.add.at(edge, last, -1)
        gone = np.cumsum(edge)[:-1] > 0
    return gone


def _runs(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Text, at, n, first_doc and first_at of all runs of a column of lists."""
    counts = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    held = column.flatten()
    return np.repeat(np.arange(len(column)), counts), *(held.field(k).to_numpy().astype(np.int64) for k in ("at", "n", "first_doc", "first_at"))


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = True) -> DataFrame:
    """Words are runs without white space (ASCII space, tab to carriage return).

    Returns for every document ``doc_id`` (unique; not null), ``n_words``, ``n_removed``,
    ``kept_sha256`` and, if asked for, ``kept``: the words that stay, joined by one
    space.  Null texts have no words.  Of windows in the same document the earlier
    one stays.  Other columns are left out.
    """
    docs = ids_and_texts(docs).where(F.col("doc_id").isNotNull())
    runs = repeats(docs, window).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "first_doc", "first_at")).alias("runs"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column(0).to_numpy(), batch.column(2)
            for at, hashes, before, _, (data, starts, ends) in word_hashes(batch.column(1), white_space(), chunk=CHUNK_BYTES):
                here = ids[at : at + len(before) - 1]
                gone = locate(here, hashes, before, _runs(found.slice(at, len(here))), window)
                raw, out = data.tobytes(), []
                a, b, stays = starts.tolist(), ends.tolist(), (~gone).tolist()
                for i, doc in enumerate(here.tolist()):
                    lo, hi = int(before[i]), int(before[i + 1])
                    kept = b" ".join([raw[a[j] : b[j]] for j in range(lo, hi) if stays[j]])
                    out.append((doc, hi - lo, int(gone[lo:hi].sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                if out:
                    yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), KEPT.types, strict=True)], schema=KEPT)

    joined = docs.join(runs, "doc_id", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
