"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items.

The index is inverted, with weights divided by what an item scores for its own
text, so one threshold serves all items.  Postings lie in blocks of items with
their largest weight.  A passage is dropped as block-max WAND does it, for all
passages of a chunk at once: first where the largest weights of its terms' lists
cannot reach the threshold (very common terms count with a bound for all of them
together), then, item block by item block, where the blocks' largest weights
cannot; only what is left is scored.  All items at or above the threshold are
retrieved, and an item counts as leaked where its question and its answer are
both found again in the passage.

How often words occur, and how long entries are, is counted over all items with
Spark.  An index is made on the driver from a bounded number of items and words and
goes to every task; a larger benchmark is taken in several such shards, one after the
other, with the same statistics, so scores do not depend on its size or its cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.store import ids_and_texts, stage
from maskframe.llm.words import letters_and_digits, ranges, window_hashes, word_hashes

#: Items and characters of items in one index.
SHARD_ITEMS, SHARD_CHARS = 20_000, 20_000_000
#: Words that an index entry has at most; passages have twice as many and begin this far apart, so each entry fits into one.
ENTRY = 64
ITEMS_PER_BLOCK = 16
GRAM = 3
K1, B = 1.2, 0.75


def item_words(column: pa.Array) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    return [h for _, hashes, before, _, _ in word_hashes(column, letters_and_digits(), fold=True) for h in np.split(hashes, before[1:-1])]


def entries(words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct words and their counts in each entry of an item."""
    return [np.unique(words[a : a + ENTRY], return_counts=True) for a in range(0, len(words), ENTRY)]


class Index:
    """An index of (item, text); fields are plain arrays, so it can be shipped to tasks.

    ``known`` has the statistics of all items: their terms, sorted, the number of entries with
    each, the number of entries, and that of words in them.  Without it the given items are all.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float, known: tuple[np.ndarray, np.ndarray, int, int] | None = None) -> None:
        self.item = np.array([i for i, _ in items], np.int64)
        words = item_words(pa.array([t for _, t in items], pa.string()))
        self.length = np.array([len(w) for w in words], np.int64)
        self.entry_of: list[int] = []
        rows = []
        for i, w in enumerate(words):
            made = entries(w)
            rows += made
            self.entry_of += [i] * len(made)
        self.entry_of = np.array(self.entry_of, np.int64)
        n = len(rows)
        self.n, self.threshold = n, threshold
        all_terms = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.uint64)
        entry = np.repeat(np.arange(n), [len(r[0]) for r in rows])
        often = np.concatenate([r[1] for r in rows]).astype(float) if rows else np.zeros(0)
        self.terms, term, df = np.unique(all_terms, return_inverse=True, return_counts=True)
        size = np.bincount(entry, often, n)
        among, total = n, size.sum()
        if known is not None:
            df, among, total = known[1][np.searchsorted(known[0], self.terms)], known[2], known[3]
        weight = np.log(1 + (among - df + 0.5) / (df + 0.5))[term] * often * (K1 + 1) / (often + K1 * (1 - B + B * size / max(total / max(among, 1), 1))[entry])
        weight /= np.bincount(entry, weight, n)[entry]
        order = np.lexsort((entry, term))
        term, self.entry, self.weight = term[order], entry[order], weight[order]
        self.at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.weight, self.at[:-1]) if len(term) else np.zeros(0)
        block = term * (n // ITEMS_PER_BLOCK + 1) + self.entry // ITEMS_PER_BLOCK
        first = np.flatnonzero(np.diff(block, prepend=-1))
        self.block, self.block_most = self.entry[first] // ITEMS_PER_BLOCK, np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.block_at = np.searchsorted(term[first], np.arange(len(self.terms) + 1))
        # The commonest terms that together stay below half the threshold in every item count as always there.
        sums, self.common, self.bound = np.zeros(n), np.zeros(len(self.terms), dtype=bool), 0.0
        for t in np.argsort(-df, kind="stable").tolist():
            more = sums.copy()
            more[self.entry[self.at[t] : self.at[t + 1]]] += self.weight[self.at[t] : self.at[t + 1]]
            if more.max() >= threshold / 2:
                break
            sums, self.common[t], self.bound = more, True, float(more.max())
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        self.question, self.answer = [], []
        for w in words:
            cut = len(w) - max(1, len(w) // 3) if len(w) > 1 else 0
            self.question.append(_grams(w[:cut]))
            self.answer.append(_grams(w[cut:]))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that the index knows, and their terms."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        term = np.searchsorted(self.terms, hashes[at])
        known = self.terms[np.minimum(term, len(self.terms) - 1)] == hashes[at] if len(at) else np.zeros(0, dtype=bool)
        return at[known], term[known]

    def search(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, entry and score of all hits; the input's pairs are distinct, passages count from 0."""
        blocks = self.n // ITEMS_PER_BLOCK + 1
        n = self.block_at[term + 1] - self.block_at[term]
        at = ranges(self.block_at[term], n)
        bound = np.bincount(np.repeat(passage, n) * blocks + self.block[at], self.block_most[at], (int(passage.max()) + 1) * blocks if len(passage) else 0)
        n = self.at[term + 1] - self.at[term]
        at, passage = ranges(self.at[term], n), np.repeat(passage, n)
        can = bound[passage * blocks + self.entry[at] // ITEMS_PER_BLOCK] >= self.threshold - 1e-9
        key, place = np.unique(passage[can] * self.n + self.entry[at[can]], return_inverse=True)
        score = np.bincount(place, self.weight[at[can]], len(key))
        hit = score >= self.threshold - 1e-9
        return key[hit] // self.n, key[hit] % self.n, score[hit]


def _grams(words: np.ndarray) -> np.ndarray:
    n = max(1, min(GRAM, len(words)))
    return np.unique(window_hashes(words, np.array([0, len(words)]), n)[0]), n


def _overlap(grams: tuple[np.ndarray, int], words: np.ndarray) -> float:
    """Share of grams found in a run of words; nothing to find counts as found."""
    wanted, n = grams
    if not len(wanted):
        return 1.0
    return float(np.isin(wanted, window_hashes(words, np.array([0, len(words)]), n)[0]).mean())


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("at_word", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])


def statistics(items: DataFrame) -> tuple[DataFrame, int, int]:
    """``shard``, ``term`` and ``df``, the number of entries of all items with a term; the number of entries; that of words in them.

    ``items`` has ``shard`` and ``text``.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, words in zip(batch.column(0).to_pylist(), item_words(batch.column(1)), strict=True):
                made = entries(words)
                if made:
                    term, n = np.unique(np.concatenate([t for t, _ in made]), return_counts=True)
                    columns = [pa.array(np.full(len(term) + 1, shard, np.int32)), pa.array(np.append(term.view(np.int64), 0)), pa.array(np.append(n, len(made))), pa.array(np.append(np.zeros(len(term), np.int64), len(words)))]
                    whole = pa.array(np.append(np.zeros(len(term), bool), True))
                    yield pa.record_batch([*columns, whole], names=["shard", "term", "n", "words", "whole"])

    counted = items.select("shard", "text").mapInArrow(rows, "shard int, term long, n long, words long, whole boolean")
    counted = stage(counted.groupBy("shard", "term", "whole").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "benchmark-terms")
    total = counted.where("whole").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    of_shards = counted.where("not whole")
    df = of_shards.groupBy("term").agg(F.sum("n").alias("df"))
    return of_shards.select("shard", "term").join(df, "term"), total[0], total[1]


def _searched(texts: DataFrame, index: Index, overlap: float, last: bool) -> DataFrame:
    """The leaks of an index's items; unless it is the last one they are written before the next index is made."""
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, hashes, before, _, _ in word_hashes(batch.column(1), letters_and_digits(), fold=True):
                out = [(ids[first + text], x.item[item], at, *rest) for text, item, at, *rest in leaks(x, hashes, before, overlap)]
                if out:
                    yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), FOUND.types, strict=True)], schema=FOUND)

    found = texts.mapInArrow(rows, "doc_id long, item_id long, at_word long, score double, question double, answer double")
    if last:
        return found
    found = stage(found, "leaks")
    shared.unpersist()
    return found


def leaks(x: Index, hashes: np.ndarray, before: np.ndarray, overlap: float) -> list[tuple[int, int, int, float, float, float]]:
    """Text, item, first word of the passage, score and overlaps: the best passage of each text and item that is verified."""
    at, term = x.find(hashes)
    if not len(at):
        return []
    text = np.searchsorted(before, at, side="right") - 1
    # Passages are numbered through all texts; one more for each text, before its first whole one.
    count = np.diff(before) // ENTRY + 2
    base = np.cumsum(count) - count
    passage = base[text] + (at - before[text]) // ENTRY + 1
    both = np.concatenate((passage, passage - 1))

    def distinct(passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.sort(passage * len(x.terms) + term)
        key = key[np.diff(key, prepend=-1) > 0]
        return key // len(x.terms), key % len(x.terms)

    rare = ~x.common[term]
    p, t = distinct(both[np.tile(rare, 2)], np.tile(term[rare], 2))
    can = np.bincount(p, x.most[t], int(count.sum())) + x.bound >= x.threshold - 1e-9
    kept = can[both]
    p, t = distinct(both[kept], np.tile(term, 2)[kept])
    numbers, p = np.unique(p, return_inverse=True)
    best: dict[tuple[int, int], tuple] = {}
    for lo in range(0, len(numbers), 1024):
        here = (p >= lo) & (p < lo + 1024)
        for k, entry, score in zip(*(c.tolist() for c in x.search(p[here] - lo, t[here])), strict=True):
            number = int(numbers[lo + k])
            doc = int(np.searchsorted(base, number, side="right") - 1)
            item = int(x.entry_of[entry])
            start = max(0, (number - int(base[doc]) - 1) * ENTRY)
            reach = int(x.length[item])
            run = hashes[max(before[doc], before[doc] + start - reach) : min(before[doc + 1], before[doc] + start + 2 * ENTRY + reach)]
            question, answer = _overlap(x.question[item], run), _overlap(x.answer[item], run)
            if question >= overlap and answer >= overlap and (question + answer, score) > best.get((doc, item), (0, 0, 0))[3:5]:
                best[doc, item] = (start, score, question, question + answer, score, answer)
    return [(doc, item, b[0], b[1], b[2], b[5]) for (doc, item), b in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """A row for each document and test item that leaks into it.

    ``doc_id``, ``item_id``, ``at_word`` (where the best passage begins), ``score`` (BM25, 1 for
    the item's own text), ``question`` and ``answer`` (share of the 3-word runs of the
    item's first two thirds and last third that the passage has).  Words are runs
    of letters and digits, without case.  Null and empty texts and items match
    nothing; of items with one id each is searched.  Statistics are those of all items.
    Documents are read once for each shard of the benchmark.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ITEMS), -(-chars // SHARD_CHARS))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    terms, among, words = statistics(items)
    texts, found = ids_and_texts(docs), []
    for k in range(shards):
        held = items.where(F.col("shard") == k).orderBy("item_id", "text").collect()
        counted = terms.where(F.col("shard") == k).select("term", "df").toArrow()
        term, df = counted["term"].to_numpy().astype(np.int64).view(np.uint64), counted["df"].to_numpy().astype(np.int64)
        order = np.argsort(term)
        index = Index([(r.item_id, r.text) for r in held], threshold, (term[order], df[order], among, words))
        found.append(_searched(texts, index, overlap, k == shards - 1))
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """The documents into which no item leaks, with all their columns; rows with a null ``doc_id`` stay."""
    leaked = stage(contaminated(docs, benchmark, threshold, overlap).select("doc_id").where("doc_id is not null").distinct(), "leaked")
    return docs.join(leaked, "doc_id", "left_anti").select(*docs.columns)
