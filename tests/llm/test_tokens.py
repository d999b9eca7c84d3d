"""Token ids, token files and packing: exact round trips and rules checked row by row."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskframe.llm import packing, tokenfile
from maskframe.llm.queries import op2_token_file, op6_packing
from maskframe.llm.tokens import encoder, vocabulary_path


@pytest.fixture(scope="module")
def ids_of():
    """A plain call of the library, apart from the encoder under test."""
    coder = Tokenizer.from_file(vocabulary_path())

    def run(text):
        return [*coder.encode(text or "", add_special_tokens=False).ids, 2]

    return run


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_pieces_have_the_ids_of_the_whole_text(ids_of):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(" \n\t .,ab'1éß|\xa0\x1c　🙂<|s") for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    texts += [None, "", "\n\n", "x.\n\n y", "it's <|endoftext|> don't", "a<|endoftext|>b.<|endoftext|>\n<|endoftext|> <|endoftext|", "<|endoftext|>"]
    got = [ids[a:b].tolist() for _, ids, bounds in encoder().encode(pa.array(texts), 2) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert got == [ids_of(t) for t in texts]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1001])
def test_variable_length_code(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 1 << 32, n, dtype=np.uint32) >> rng.integers(0, 32, n).astype(np.uint32)
    control, data, sizes = tokenfile.encode(values)
    assert sizes.tolist() == [len(data)]
    assert len(control) == -(-n // 4)
    assert tokenfile.decode(control, data, n).tolist() == values.tolist()


def test_token_file_query(spark, sf, documents, ids_of):
    rows = {r.doc_id: r for r in op2_token_file(spark, sf).collect()}
    start = 0
    docs = sorted(documents, key=lambda d: d.doc_id)
    assert len(rows) == len(docs)
    for d in docs:
        ids = ids_of(d.text)
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_token_file_of_odd_rows(spark, make, odd_rows, ids_of):
    docs = make([*odd_rows, (None, "no id")]).withColumn("ids", F.lit("x")).withColumn("part", F.lit(1))
    rows = tokenfile.round_trip(docs).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(ids_of(t)), crc(ids_of(t))) for i, t in [*odd_rows, (None, "no id")])
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_token_file_of_nothing(spark, make):
    assert tokenfile.round_trip(make([])).count() == 0


def test_piece_lengths():
    assert packing.piece_lengths(5, 4) == [1, 4]
    assert packing.piece_lengths(8, 4) == [4, 4]
    assert packing.piece_lengths(3, 4) == [3]
    assert packing.piece_lengths(4, 4) == [4]


def test_sum_of_squares_rule():
    """Each length goes where the sum of squares over gaps becomes smallest, by trying every place."""
    size, rnd = 12, random.Random(2)
    lengths = np.array([rnd.randint(1, size) for _ in range(300)])
    count, used = Counter(), 0
    for n in lengths.tolist():
        def total(level, n=n):
            c = count.copy()
            if level:
                c[level] -= 1
            if level + n < size:
                c[level + n] += 1
            return sum(v * v for v in c.values())

        places = [h for h in range(1, size - n + 1) if count[h]]
        best = min([total(0), *map(total, places)])
        level = 0 if total(0) == best else min(h for h in places if total(h) == best)
        used += not level
        if level:
            count[level] -= 1
        if level + n < size:
            count[level + n] += 1
    bins, offsets = packing.sum_of_squares(lengths, size)
    assert bins.max() + 1 <= used  # what was left open is placed once more
    held = defaultdict(list)
    for n, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        held[b].append((o, n))
    for parts in held.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= size


def check_packing(rows, docs, ids_of):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    copies = Counter(i for i, _ in docs)
    assert set(by_doc) == set(copies)
    for i, text in docs:
        ids = ids_of(text)
        wanted, start = [], 0
        for k, n in enumerate(packing.piece_lengths(len(ids), 1024)):
            wanted.append((k, start, n, crc(ids[start : start + n])))
            start += n
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[i]) == Counter({w: copies[i] for w in wanted})
    for parts in by_sequence.values():
        end = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 1024
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_query(spark, sf, documents, ids_of):
    rows = op6_packing(spark, sf).collect()
    used, tokens = check_packing(rows, [(d.doc_id, d.text) for d in documents], ids_of)
    assert used <= 1.03 * -(-tokens // 1024)


def test_packing_odd_rows(spark, make, odd_rows, ids_of):
    docs = make(odd_rows).withColumn("slot", F.lit("x")).withColumn("length", F.lit(None))
    check_packing(packing.pack(docs).collect(), odd_rows, ids_of)
    assert packing.pack(make([])).count() == 0


def test_sequences_hold_the_ids(spark, make, ids_of):
    docs = make([(i, f"some words number {i} " * (40 * i)) for i in range(12)])
    held = packing.sequences(packing.pack(docs), tokenfile.tokenize(docs)).collect()
    ids = Counter(x for r in held for x in np.frombuffer(bytes(r.ids), "<u2").tolist())
    assert all(len(r.ids) <= 2 * 1024 for r in held)
    assert ids == Counter(x for i in range(12) for x in ids_of(f"some words number {i} " * (40 * i)))
