"""Lyndon words, periodic runs and collapsed texts against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from maskframe.llm import runs
from maskframe.llm.queries import op13_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lyndon_words(s):
    out = []
    for i in range(len(s)):
        fits = [j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))]
        out.append(max(fits))
    return out


def all_runs(words, exponent=4, least=6):
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            unit = words[i : i + length]
            if j > i and length >= max(least, exponent * q) and not any(unit[:-p] == unit[p:] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def edited(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def expected(words):
    found = all_runs(words)
    gone = [any(s + q <= i < s + n for s, n, q in found) for i in range(len(words))]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
    return (len(found), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_longest_lyndon_words_at_every_place():
    rnd = random.Random(1)
    for _ in range(600):
        s = [rnd.randrange(rnd.randint(1, 4)) for _ in range(rnd.randint(0, 22))]
        assert runs.lyndon_array(s) == lyndon_words(s)


def test_query_against_brute_force(spark, sf, documents):
    got = {r.doc_id: tuple(r)[1:] for r in op13_runs(spark, sf).collect()}
    short = [d for d in documents if len(WORD.findall(d.text or "")) <= 900]
    assert len(got) == len(documents) and len(short) > 150
    assert sum(1 for d in short if got[d.doc_id][0]) > 10
    for d in short:
        assert got[d.doc_id] == expected(edited(d.doc_id, d.text)), d.doc_id


def test_planted_runs(make):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        w = []
        for _ in range(rnd.randint(0, 5)):
            unit = [f"w{rnd.randrange(rnd.choice([1, 2, 3, 50]))}" for _ in range(rnd.randint(1, 9))]
            w += (unit * rnd.randint(1, 9))[: rnd.randint(1, 70)]
        rows.append((i, rnd.choice([" ", "\n", " \t "]).join(w)))
    got = {r.doc_id: r for r in runs.collapse(make(rows)).collect()}
    for i, text in rows:
        words = WORD.findall(text)
        assert [(r.start, r.length, r.period) for r in got[i].runs] == all_runs(words)
        assert got[i].n_words == len(words)
        gone = [any(r.start + r.period <= k < r.start + r.length for r in got[i].runs) for k in range(len(words))]
        assert got[i].collapsed == " ".join(w for w, g in zip(words, gone, strict=True) if not g)


@pytest.mark.parametrize("exponent,least", [(2, 2), (3, 9), (5, 1)])
def test_other_bounds(make, exponent, least):
    rnd = random.Random(exponent)
    rows = [(i, " ".join(rnd.choice("ab" if i % 2 else "abcd") for _ in range(60))) for i in range(60)]
    for r in runs.collapse(make(rows), exponent, least).collect():
        assert [(x.start, x.length, x.period) for x in r.runs] == all_runs(rows[r.doc_id][1].split(), exponent, least)


def test_odd_rows(spark, make, odd_rows):
    rows = [*odd_rows, (None, "a b " * 9), (None, None), (11, "x " * 200_000), (12, " ".join(["p q r"] * 30_000))]
    clash = make(rows).withColumn("runs", F.lit(1)).withColumn("g", F.lit(2)).withColumn("collapsed", F.lit("z"))
    got = runs.collapse(clash).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert by_id[11].collapsed == "x" and [tuple(r) for r in by_id[11].runs] == [(0, 200_000, 1)]
    assert by_id[12].collapsed == "p q r" and [tuple(r) for r in by_id[12].runs] == [(0, 90_000, 3)]
    assert by_id[1].n_words == 0 and by_id[1].collapsed == "" and by_id[1].runs == []
    assert sorted(r.collapsed for r in got if r.doc_id is None) == ["", "a b"]
    digests = {r.doc_id: r for r in runs.digests(runs.collapse(runs.with_periodic_tails(clash))).collect()}
    assert digests[1].start is None and digests[1].runs_sha256 == hashlib.sha256(b"").hexdigest()
    for i, text in odd_rows[:5]:
        assert tuple(digests[i])[1:] == expected(edited(i, text))
    assert runs.collapse(make([])).count() == 0
