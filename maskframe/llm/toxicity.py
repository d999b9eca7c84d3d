"""Toxicity: words as bags of character n-grams, averaged over a window into a linear softmax.

A word's vector is the mean of the vectors of its n-grams (hashed into a fixed
number of rows) and of the whole word; a window's is the mean of its words'.  A
text is cut into overlapping windows of two words and scores as its worst one, so a
word or two count as much in a long text as in a short one.  Embeddings and softmax are
trained together by gradient descent in numpy on texts with one label each: at
first on random windows, then on each text's worst ones.  One component of an
embedding begins with how much likelier its n-gram is in toxic training texts than
in clean ones, so that few labels are enough.

What a trained model does to a word is one number, the mean of its n-grams'
numbers, which is all that is shipped and all that scoring computes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.sample import per_label
from maskframe.llm.store import ids_and_texts, release_memory, stage
from maskframe.llm.words import _powers, letters_and_digits, mix, ranges, word_hashes

ROWS, WIDE = 1 << 18, 8
GRAMS = (3, 4, 5)
#: Words in a window, and between the starts of two.
WINDOW, STEP = 2, 1
#: Share of an n-gram's vector that goes in each step that uses it, times the rate.
DECAY = 0.004
#: What an n-gram begins with: so much of its log odds, if so many texts have it, each label counted with so many more.
START, START_TEXTS, START_MORE = 0.7, 3, 1.0
#: Words whose n-grams are made at a time.
PART = 20_000
#: Log odds of every text where nothing was learned.
NO_LABELS = -4.0
#: Texts of each label that a model is fitted on, about.
SAMPLE = 1500


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all n-grams of words (with a mark at each end), and where each word's begin."""
    n = ends - starts
    marked = np.full(int((n + 2).sum()), ord("<"), np.uint64)
    at = np.cumsum(n + 2) - (n + 2)
    marked[ranges(at + 1, n)] = data[ranges(starts, n)]
    marked[at + n + 1] = ord(">")
    parts, counts = [], []
    for k in (*GRAMS, 0):  # 0: the whole word
        found = np.maximum(n + 2 - k + 1, 0) if k else np.ones(len(n), np.int64)
        first = ranges(at, found)
        hashed = np.full(len(first), k, np.uint64)
        if k:
            for i in range(k):
                hashed = hashed * np.uint64(0x100000001B3) + marked[first + i]
        else:
            sums = np.zeros(len(marked) + 1, np.uint64)
            np.cumsum(mix(marked) * _powers(0xD1342543DE82EF95, len(marked))[: len(marked)], out=sums[1:])
            hashed = (sums[at + n + 2] - sums[at]) * _powers(pow(0xD1342543DE82EF95, -1, 1 << 64), len(marked))[at]
        parts.append((mix(hashed) & np.uint64(ROWS - 1)).astype(np.int32))
        counts.append(found)
    total = np.sum(counts, axis=0)
    begins = np.concatenate(([0], np.cumsum(total)))
    out, fill = np.empty(int(begins[-1]), np.int32), begins[:-1].copy()
    for rows, found in zip(parts, counts, strict=True):
        out[ranges(fill, found)] = rows
        fill = fill + found
    return out, begins


def distinct_words(hashes: np.ndarray, place: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words with their places in a run of bytes: which distinct word each is, and the n-grams of those."""
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    data, starts, ends = place
    parts = [word_grams(data, starts[first[a : a + PART]], ends[first[a : a + PART]]) for a in range(0, max(len(first), 1), PART)]
    begins = np.concatenate([np.zeros(1, np.int64), *[np.diff(b) for _, b in parts]]).cumsum()
    return which, np.concatenate([g for g, _ in parts]), begins


def windows(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of each window, and the number of windows before each text; a text without words has none."""
    words = np.diff(before)
    count = np.where(words > 0, np.maximum(-(-(words - WINDOW) // STEP), 0) + 1, 0)
    start = np.repeat(before[:-1], count) + STEP * ranges(np.zeros(len(count), np.int64), count)
    return start, np.minimum(WINDOW, np.repeat(before[1:], count) - start), np.concatenate(([0], np.cumsum(count)))


@dataclass
class Model:
    rows: np.ndarray  # what each n-gram adds to the log odds
    bias: float

    def scores(self, hashes: np.ndarray, before: np.ndarray, place: tuple) -> np.ndarray:
        out = np.full(len(before) - 1, self.bias)
        if len(hashes):
            which, grams, begins = distinct_words(hashes, place)
            word = np.add.reduceat(self.rows[grams], begins[:-1]) / np.diff(begins)
            sums = np.concatenate(([0.0], np.cumsum(word[which])))
            start, size, at = windows(before)
            some = np.diff(at) > 0
            out[some] += np.maximum.reduceat((sums[start + size] - sums[start]) / size, at[:-1][some])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def log_odds(labels: list[int], which: np.ndarray, grams: np.ndarray, begins: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of every n-gram: how much likelier a toxic text has it than a clean one; 0 for rare n-grams."""
    seen = np.zeros((2, ROWS))
    for label, a, b in zip(labels, before[:-1].tolist(), before[1:].tolist(), strict=True):
        if a < b:
            word = np.unique(which[a:b])
            seen[label, np.unique(grams[ranges(begins[:-1][word], np.diff(begins)[word])])] += 1
    texts = np.bincount(np.array(labels, np.int64), minlength=2)
    odds = [np.log((seen[k] + START_MORE) / (texts[k] + 2 * START_MORE)) for k in (0, 1)]
    return np.where(seen.sum(axis=0) >= START_TEXTS, odds[1] - odds[0], 0).astype(np.float32)


def fit(texts: list[str], labels: list[int], epochs: int = 30, rate: float = 0.3, seed: int = 1) -> Model:
    """Fit embeddings and softmax on whole texts; the classes weigh as much as each other."""
    rng = np.random.default_rng(seed)
    parts = list(word_hashes(pa.array(texts, pa.string()), letters_and_digits(), fold=True))
    begins, words, data_at = [], [], 0
    before, place = [np.zeros(1, np.int64)], []
    for _, hashes, b, _, (data, s, e) in parts:
        words.append(hashes)
        before.append(b[1:] + before[-1][-1])
        place.append((data, s + data_at, e + data_at))
        data_at += len(data)
    before = np.concatenate(before)
    which, grams, begins = distinct_words(np.concatenate(words), (np.concatenate([p[0] for p in place]), np.concatenate([p[1] for p in place]), np.concatenate([p[2] for p in place])))
    start, size, at = windows(before)
    some = np.flatnonzero(np.diff(at) > 0)
    label = np.array(labels)[some]
    weight = np.where(label == 1, 0.5 / max(1, label.sum()), 0.5 / max(1, (1 - label).sum())) * len(label)
    embedding = rng.normal(0, 0.1, (ROWS, WIDE)).astype(np.float32)
    softmax, bias = rng.normal(0, 0.5, (WIDE, 2)).astype(np.float32), np.zeros(2, np.float32)
    embedding[:, 0] = START * log_odds(labels, which, grams, begins, before)
    softmax[0] = -0.5, 0.5
    sums_e, sums_s = np.full(ROWS, 1e-6, np.float32), np.full((WIDE, 2), 1e-6, np.float32)
    for epoch in range(epochs):
        if epoch < epochs // 3:
            chosen = np.concatenate([at[some] + (rng.random(len(some)) * np.diff(at)[some]).astype(np.int64) for _ in range(3)])
            text = np.tile(np.arange(len(some)), 3)
        else:
            row = embedding @ (softmax[:, 1] - softmax[:, 0])
            word = np.add.reduceat(row[grams], begins[:-1]) / np.diff(begins)
            total = np.concatenate(([0.0], np.cumsum(word[which])))
            logit = (total[start + size] - total[start]) / size
            worst = np.flatnonzero(logit == np.repeat(np.maximum.reduceat(logit, at[some]), np.diff(at)[some]))
            worst = worst[np.searchsorted(worst, at[some])]
            # Of clean texts any window is clean: two more of each, at random.
            clean = np.flatnonzero(label == 0)
            more = [at[some][clean] + (rng.random(len(clean)) * np.diff(at)[some][clean]).astype(np.int64) for _ in range(2)]
            chosen, text = np.concatenate([worst, *more]), np.concatenate([np.arange(len(some)), clean, clean])
        for batch in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // 256)):
            w, y, importance = chosen[batch], label[text[batch]], weight[text[batch]]
            word = which[ranges(start[w], size[w])]
            n = np.diff(begins)[word]
            gram = grams[ranges(begins[:-1][word], n)]
            share = np.repeat(1 / (np.repeat(size[w], size[w]) * n), n).astype(np.float32)
            owner = np.repeat(np.repeat(np.arange(len(w)), size[w]), n)
            edges = np.searchsorted(owner, np.arange(len(w)))
            vector = np.add.reduceat(embedding[gram] * share[:, None], edges)
            z = vector @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= importance[:, None] / len(y)
            back = (p @ softmax.T).astype(np.float32)
            step = vector.T @ p
            sums_s += step**2
            softmax -= rate * step / np.sqrt(sums_s)
            bias -= rate * 0.1 * p.sum(axis=0)
            used, where = np.unique(gram, return_inverse=True)
            change = np.stack([np.bincount(where, back[owner, d] * share, len(used)) for d in range(WIDE)], axis=1).astype(np.float32)
            sums_e[used] += (change**2).mean(axis=1)
            embedding[used] -= rate * (change / np.sqrt(sums_e[used])[:, None] + DECAY * embedding[used])
    return Model((embedding @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: the crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` texts of each label; a text with several labels counts as toxic if one says so.

    Without texts of both labels nothing can be learned: every text scores as hardly toxic.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out())
    taken = per_label(known, "toxic", sample)
    rows = ids_and_texts(docs).join(F.broadcast(taken), "doc_id").select("text", "toxic").toArrow()
    order = np.lexsort((np.array(rows["text"].to_pylist(), object), rows["toxic"].to_numpy())) if len(rows) else []
    texts, toxic = rows["text"].to_pylist(), rows["toxic"].to_pylist()
    if len(set(toxic)) < 2:
        return Model(np.zeros(ROWS, np.float32), NO_LABELS)
    model = fit([texts[i] for i in order], [int(toxic[i]) for i in order])
    release_memory()
    return model


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every whole text; texts without words score as the model's prior says."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, before, _, place in word_hashes(batch.column(1), letters_and_digits(), fold=True):
                found = shared.value.scores(hashes, before, place)
                yield pa.record_batch([batch.column(0).slice(at, len(found)), pa.array(found)], schema=SCORED)

    return ids_and_texts(docs).mapInArrow(rows, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every document; repeated rows stay."""
    found = scores(docs, train(docs, labels, sample))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns.

    Rows with a null ``doc_id`` stay.  Of rows with one id and different texts only those go
    whose own text is rejected.
    """
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(doc, text)
    keyed = docs.where(doc.isNotNull()).select(key.alias("doc_id"), text.alias("text"))
    rejected = scores(keyed, train(docs, labels, sample)).where(F.col("score") >= threshold)
    toxic = stage(rejected.select(F.col("doc_id").alias("__toxic")).distinct(), "toxic")
    return docs.join(toxic, doc.isNotNull() & (key == F.col("__toxic")), "left_anti").select(*docs.columns)
