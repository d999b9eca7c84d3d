"""Language of a text by a convolutional network over its bytes.

Bytes are embedded; filters of several widths run over a window of fixed length;
each filter's largest response in the window goes through a softmax.  Trained in
numpy on windows of labelled texts.  A text is cut into windows from end to end,
all windows of a batch go through together, and the text gets the language with
the largest sum of log probabilities, weighted by the windows' lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.sample import per_label
from maskframe.llm.store import ids_and_texts, release_memory
from maskframe.llm.words import lower, ranges, texts

#: Bytes in a window; shorter ones are filled up with spaces.
WINDOW = 256
WIDTHS, FILTERS, WIDE = (2, 3, 4), 12, 8
#: Windows that go through the network at a time.
BATCH = 256
#: Texts of each language that a model is fitted on, about.
SAMPLE = 600


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # byte x WIDE
    filters: np.ndarray  # (longest width * WIDE) x all filters; zero beyond a filter's width
    bias: np.ndarray
    softmax: np.ndarray
    softmax_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every filter's response at every place, and the bytes' vectors of every place."""
        reach = max(WIDTHS)
        vectors = self.embedding[windows].reshape(len(windows), -1)
        n = windows.shape[1] - reach + 1
        step = vectors.strides[1]
        patches = np.lib.stride_tricks.as_strided(vectors, (len(windows), n, reach * WIDE), (vectors.strides[0], WIDE * step, step))
        return patches.reshape(-1, reach * WIDE) @ self.filters, patches

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(windows)[0].reshape(len(windows), -1, len(self.bias)).max(axis=1) + self.bias, 0)
        z = pooled @ self.softmax + self.softmax_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and number of bytes of each window, and the number of windows before each text."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    start = np.repeat(offsets[:-1], count) + WINDOW * ranges(np.zeros(len(count), np.int64), count)
    return start, np.minimum(WINDOW, np.repeat(offsets[1:], count) - start), np.concatenate(([0], np.cumsum(count)))


def window_bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    out = data[np.minimum(at, len(data) - 1)]
    out[np.arange(WINDOW) >= length[:, None]] = 0x20
    return out


def fit(samples: list[str], labels: list[str], epochs: int = 8, rate: float = 0.05, seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    data, offsets = texts(pa.array(samples, pa.string()))
    data = lower(data)
    languages = sorted(set(labels))
    start, length, at = cut_windows(data, offsets)
    # Up to eight windows of each text, at random.
    owner = np.repeat(np.arange(len(samples)), np.diff(at))
    order = np.lexsort((rng.random(len(owner)), owner))
    chosen = order[np.arange(len(order)) - at[:-1][owner[order]] < 8]
    x = window_bytes(data, start[chosen], length[chosen])
    y = np.array([languages.index(v) for v in labels])[owner[chosen]]
    reach, n = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(reach) < w).astype(np.float32), WIDE)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, WIDE)).astype(np.float32),
        rng.normal(0, 0.3, (reach * WIDE, n)).astype(np.float32) * mask,
        np.zeros(n, np.float32),
        rng.normal(0, 0.3, (n, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    weights = [net.embedding, net.filters, net.bias, net.softmax, net.softmax_bias]
    squares = [np.full_like(w, 1e-4) for w in weights]
    weight = (len(y) / (len(languages) * np.maximum(np.bincount(y, minlength=len(languages)), 1)))[y].astype(np.float32)
    for _ in range(epochs):
        for b in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            raw, patches = net.responses(x[b])
            raw = raw.reshape(len(b), -1, n)
            best = raw.argmax(axis=1)
            top = np.take_along_axis(raw, best[:, None, :], axis=1)[:, 0] + net.bias
            pooled = np.maximum(top, 0)
            z = pooled @ net.softmax + net.softmax_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            p *= weight[b][:, None] / len(b)
            back = (p @ net.softmax.T) * (top > 0)
            picked = patches[np.arange(len(b))[:, None], best]  # text x filter x patch
            d_filters = np.einsum("tfp,tf->pf", picked, back) * mask
            d_patch = back[:, :, None] * net.filters.T[None]
            letters = x[b][np.arange(len(b))[:, None, None], best[:, :, None] + np.arange(reach)]
            d_embedding = np.zeros_like(net.embedding)
            np.add.at(d_embedding, letters.reshape(-1), d_patch.reshape(-1, WIDE))
            for w, s, d in zip(weights, squares, (d_embedding, d_filters, back.sum(axis=0), pooled.T @ p, p.sum(axis=0)), strict=True):
                s += d**2
                w -= rate * d / np.sqrt(s)
    return net


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: the crc32 of the id as text can be divided by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Fit on about ``sample`` texts of each language; None if there are none to learn from."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and doc_id is not null").where(~held_out())
    rows = per_label(known.where(F.length("text") > 0), "lang", sample).select("text", "lang").toPandas().sort_values(["lang", "text"])
    if rows.empty:
        return None
    net = fit(rows["text"].tolist(), rows["lang"].tolist())
    release_memory()
    return net


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def languages(docs: DataFrame, net: Network) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every whole text; ``und`` with score 0 where the text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        names = np.array([*net.languages, "und"], dtype=object)
        for batch in batches:
            data, offsets = texts(batch.column(1))
            data = lower(data) if len(data) else data
            start, length, at = cut_windows(data, offsets)
            sums = np.zeros((len(offsets) - 1, len(net.languages)))
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
            for lo in range(0, len(start), BATCH):
                part = slice(lo, lo + BATCH)
                logs = net.log_probabilities(window_bytes(data, start[part], length[part])) * length[part][:, None]
                first = np.flatnonzero(np.diff(owner[part], prepend=-1))
                sums[owner[part][first]] += np.add.reduceat(logs, first, axis=0)
            mean = np.exp(sums / np.maximum(np.diff(offsets), 1)[:, None])
            mean /= mean.sum(axis=1, keepdims=True)
            some = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(some, mean.argmax(axis=1), len(net.languages))
            yield pa.record_batch([batch.column(0), pa.array(names[best], pa.string()), pa.array(np.where(some, mean.max(axis=1), 0.0))], schema=PREDICTED)

    letters = F.col("text").rlike(r"\p{L}").alias("letters")
    return ids_and_texts(docs).select("doc_id", "text", letters).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for every document; repeated rows stay.

    Without a text of a known language all are ``und`` with score 0.
    """
    net = train(docs, sample)
    if net is None:
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        found = languages(docs, net)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
