"""Hard negatives against all scores, in whole numbers of any size."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from maskframe.llm import negatives
from maskframe.llm.queries import op11_hard_negatives, sql

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, positives=5, kept=3, lowest=50, highest=95):
    held = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        held[i] = min(held.get(i, (label, vector)), (label, vector))
    whole = {i: (label, [math.floor(256 * x) for x in vector]) for i, (label, vector) in held.items()}
    out = []
    for a, (label, vector) in whole.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(vector, v, strict=True)), i, other) for i, (other, v) in whole.items() if i != a and len(v) == len(vector))
        for p, i, _ in [s for s in scores if s[2] == label][:positives]:
            near = [(n, j) for n, j, other in scores if other != label and lowest * -p <= 100 * -n <= highest * -p]
            out += [(a, i, r, j, -p, -n) for r, (n, j) in enumerate(near[:kept], 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(sql()["op11_hard_negatives"]).fetchall()
    got = found(op11_hard_negatives(spark, sf))
    assert len(got) > 100 and got == sorted(want)


def gaussian(n, width, seed, labels=4, step=1.0):
    rnd = random.Random(seed)
    return [(i, [round(rnd.gauss(0, 0.2) / step) * step for _ in range(width)], rnd.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("step", [1e-6, 0.25])
def test_many_shards_and_blocks(spark, monkeypatch, step):
    """Small shards and blocks, and at the coarse step very many equal scores."""
    monkeypatch.setattr(negatives, "SHARD_ROWS", 60)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 7)
    rows = gaussian(500, 5, 1, step=step)
    rows += [(500 + i, rows[0][1], i % 3) for i in range(200)]
    got = found(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert got == brute(rows, 20) and len(got) > 50


def test_reading_stops_early(monkeypatch):
    """Where few components matter, most rows are never scored."""
    import numpy as np

    rnd = np.random.default_rng(1)
    rows = np.floor(rnd.normal(0, 3, (5000, 6)))
    rows[:20] *= 40
    lists = negatives.Lists(np.arange(5000), np.zeros(5000, int), rows)
    scored = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            scored.append(len(key))
            return np.asarray(super().__getitem__(key))

    lists.rows = rows.view(Watched)
    (places, scores), = lists.best(rows[0], np.arange(5000) > 0, [(-math.inf, math.inf)], 5)
    every = rows @ rows[0]
    assert scores.tolist() == sorted(every[1:], reverse=True)[:5] and every[places].tolist() == scores.tolist()
    assert sum(scored) < 1000


def test_odd_rows(spark):
    rows = gaussian(120, 4, 2)
    rows += [(None, [0.1] * 4, 1), (1000, None, 1), (1001, [0.1, None, 0.1, 0.1], 1), (1002, [0.1, math.nan, 0.1, 0.1], 1), (1003, [math.inf] * 4, 1), (1004, [0.3] * 4, None)]
    rows += [(1050, [0.0] * 4, 1), (1100, [], 1), (1101, [], 2), (1102, [], 1), (1150, [0.5] * 3, 0), (1151, [0.4] * 3, 0), (1152, [0.35] * 3, 2)]
    rows += [(0, [9.0] * 4, 0), (50, rows[50][1], rows[50][2]), (7, [-5.0] * 4, 0)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit(1)).withColumn("slot", F.lit(2)).withColumn("rank", F.lit("r"))
    assert found(negatives.hard_negatives(clash, F.col("vec_id") % 50 == 0)) == brute(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.hard_negatives(empty, F.col("vec_id") % 50 == 0).collect() == []


def test_scores_beyond_floating_point(spark):
    """Components of up to 2**29: scores of 2**60 that differ in their last digits."""
    rnd = random.Random(5)
    rows = [(i, [float(rnd.randrange(2**20, 2**21)), float(rnd.randrange(1, 99)) / 256], i % 2) for i in range(60)]
    assert found(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)) == brute(rows, 10)
    huge = [(i, [1e30 + i * 1e28, -1e25], i % 2) for i in range(20)]
    got = found(negatives.hard_negatives(spark.createDataFrame(huge, SCHEMA), F.col("vec_id") % 10 == 0))
    assert all(-(2**63) <= r[5] < 2**63 for r in got)
