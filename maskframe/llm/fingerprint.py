"""Document fingerprints that tell how much two versions differ: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: behind line ends, and inside lines behind words
that their hash picks (one in eight), so a change moves no cut but its own.  A
sketch has cells of a count, a sum of digests and a sum of check values; each
digest is added to three cells.  The difference of two sketches holds only the
digests that differ, and peeling cells with one digest each recovers them; if
cells are left over, the sketch was too small, and both texts are sketched again
with four times the cells.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.store import ids_and_texts
from maskframe.llm.words import _BYTE_VALUES, find_words, mix, ranges, run_hashes, texts, white_space

#: Cells of a fingerprint, a multiple of three, and how much larger the next try is.
CELLS, GROWTH = 24, 4
#: Rows in a range of documents, about.
ROWS = 2000


def digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digest of every paragraph of every text, and the number of paragraphs before each text.

    Equal paragraphs of one text get different digests, by how many of them came before.
    """
    data, offsets = texts(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    values = _BYTE_VALUES[data]
    starts, ends, _ = find_words(data, offsets, white_space())
    picked = run_hashes(values, starts, ends) & np.uint64(7) == 0 if len(starts) else np.zeros(0, bool)
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:][data == 0x0A] = True
    cut[ends[picked]] = True
    cut[offsets] = True
    at = np.flatnonzero(cut)
    found = run_hashes(values, at[:-1], at[1:], 0xDA942042E4DD58B5)
    before = np.searchsorted(at, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    order = np.lexsort((found, text))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (found[order][1:] != found[order][:-1]) | (text[order][1:] != text[order][:-1])
    earlier = np.empty(len(order), np.int64)
    earlier[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return mix(found + earlier.astype(np.uint64)), before


def _cells(keys: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each key among those of its owner, one in each third."""
    third = cells // 3
    return np.stack([owner * cells + i * third + (mix(keys + np.uint64(i + 1)) % np.uint64(third)).astype(np.int64) for i in range(3)])


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def sketch(keys: np.ndarray, owner: np.ndarray, sign: np.ndarray, owners: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, key sums and check sums of the cells of all owners' sketches; sign is 1 to add and -1 to take away."""
    at = _cells(keys, owner, cells).ravel()
    signed = sign.astype(np.int64).view(np.uint64)
    count = np.bincount(at, np.tile(sign, 3), owners * cells).astype(np.int64)
    sums = np.zeros((2, owners * cells), np.uint64)
    np.add.at(sums[0], at, np.tile(keys * signed, 3))
    np.add.at(sums[1], at, np.tile(_check(keys) * signed, 3))
    return count, sums[0], sums[1]


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray, owners: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """How many digests each owner's sketch gives up, and whether nothing is left in it; the arrays are used up."""
    found = np.zeros(owners, np.int64)
    look = np.flatnonzero(np.abs(count) == 1)
    while len(look):
        sign = count[look]
        one = key[look] * sign.view(np.uint64)
        pure = (np.abs(sign) == 1) & (check[look] * sign.view(np.uint64) == _check(one))
        look, one, sign = look[pure], one[pure], sign[pure]
        if not len(look):
            break
        owner = look // cells
        order = np.lexsort((one, owner))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        one, owner, sign = one[order][new], owner[order][new], sign[order][new]
        found += np.bincount(owner, minlength=owners)
        at = _cells(one, owner, cells).ravel()
        back = np.tile((-sign).view(np.uint64), 3)
        np.add.at(count, at, np.tile(-sign, 3))
        np.add.at(key, at, np.tile(one, 3) * back)
        np.add.at(check, at, np.tile(_check(one), 3) * back)
        look = np.unique(at)
    left = (count != 0) | (key != 0)
    return found, ~left.reshape(owners, cells).any(axis=1)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Jaccard similarity of the paragraph digests of the i-th text of a and of b, from their sketches' difference; two empty texts are alike."""
    n = np.diff(a[1]) + np.diff(b[1])
    differing, todo, cells = np.zeros(len(n), np.int64), np.arange(len(n)), CELLS
    while len(todo):
        keys, owner, sign = [], [], []
        for (held, before), s in ((a, 1), (b, -1)):
            size = np.diff(before)[todo]
            keys.append(held[ranges(before[:-1][todo], size)])
            owner.append(np.repeat(np.arange(len(todo)), size))
            sign.append(np.full(len(owner[-1]), s, np.int64))
        found, clear = peel(*sketch(np.concatenate(keys), np.concatenate(owner), np.concatenate(sign), len(todo), cells), len(todo), cells)
        differing[todo[clear]] = found[clear]
        todo, cells = todo[~clear], cells * GROWTH
    return np.where(n > 0, (n - differing) / np.maximum(n + differing, 1), 1.0)


def fingerprints(held: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The sketch of each text as text: number of paragraphs, then count, key sum and check sum of each cell."""
    keys, before = held
    n = len(before) - 1
    count, key, check = sketch(keys, np.repeat(np.arange(n), np.diff(before)), np.ones(len(keys), np.int64), n, CELLS)
    row = np.zeros((n, 4 + CELLS * 16), np.uint8)
    row[:, :4] = np.diff(before).astype("<u4").view(np.uint8).reshape(n, 4)
    cell = np.zeros(n * CELLS, dtype=[("count", "<u4"), ("key", "<u8"), ("check", "<u4")])
    cell["count"], cell["key"], cell["check"] = count, key, check & np.uint64(0xFFFFFFFF)
    row[:, 4:] = cell.view(np.uint8).reshape(n, -1)
    return [base64.b64encode(r).decode() for r in row]


def in_ranges(docs: DataFrame) -> DataFrame:
    """``part``, ``extra``, ``doc_id``, ``text``, each part in ascending order, with the document after its last one at the end as an extra.

    Only the bounds of the parts, one number for each, come to the driver; there are at most
    four parts for each shuffle partition of the session, and a part of any size is
    read in order, a few texts at a time.
    """
    n = docs.count()
    parts = max(1, min(-(-n // ROWS), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    steps = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.min("doc_id"), *([F.percentile_approx("doc_id", steps, max(10_000, 10 * parts))] if steps else [])).first()
    bounds = np.unique([bounds[0], *(bounds[1] if steps else [])]) if n else np.zeros(1, np.int64)
    parts = len(bounds)

    @F.pandas_udf("array<int>")
    def places(doc_id: pd.Series) -> pd.Series:
        ids = doc_id.to_numpy()
        part = np.searchsorted(bounds, ids, side="right") - 1
        first = bounds[part] == ids
        return pd.Series([[p, (p - 1) % parts] if f else [p] for p, f in zip(part.tolist(), first.tolist(), strict=True)])

    rows = docs.select("doc_id", "text", F.posexplode(places("doc_id")).alias("extra", "part"))
    return rows.repartition(parts, "part").sortWithinPartitions("part", "extra", "doc_id", F.xxhash64("text")).select("part", "extra", "doc_id", "text")


EDITED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Every document against a version whose last quarter comes from the next document, and against the next document.

    Next is by ascending ``doc_id``; behind the last comes the first; rows with one
    id follow each other by a hash of their text.  Null texts are empty; rows with
    a null ``doc_id`` are left out.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch | None:
            own = [i for i in range(len(held) - 1) if not held[i][1]]
            if not own:
                return None
            own_texts = [held[i][3] for i in own]
            later = [held[i + 1][3] for i in own]
            cut = [len(t) // 4 for t in own_texts]
            edited = [t[: len(t) - q] + x[:q] for t, x, q in zip(own_texts, later, cut, strict=True)]
            a, b, c = (digests(pa.array(x, pa.large_string())) for x in (own_texts, edited, later))
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
            columns = [[held[i][2] for i in own], [len(t) for t in own_texts], sha, fingerprints(a), fingerprints(b), likeness(a, b), likeness(a, c)]
            return pa.record_batch([pa.array(x, type=t) for x, t in zip(columns, EDITED.types, strict=True)], schema=EDITED)

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[-1][0] != row[0] or size > 1 << 20):
                    # The last row waits for its next one, unless its part is over.
                    if held[-1][0] == row[0]:
                        held.append(row)
                    if (out := done()) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held and (out := done()) is not None:
            yield out

    ordered = in_ranges(ids_and_texts(docs).where("doc_id is not null"))
    return ordered.mapInArrow(rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
