"""Repeated passages, near copies, aligned lines and leaks against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskframe.llm import components, decontaminate, lines, near, substrings
from maskframe.llm.queries import op1_decontamination, op4_substring_dedup, op5_ngram_join, op7_line_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def without_repeats(docs, window=20):
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        w = words(text)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                gone[a : a + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def as_repeats(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_repeated_passages_query(spark, sf, documents):
    assert as_repeats(op4_substring_dedup(spark, sf)) == without_repeats([(d.doc_id, d.text) for d in documents])


def test_repeated_passages_planted(spark, make):
    rnd = random.Random(4)
    vocabulary = [f"v{i}" for i in range(60)] + ["the"] * 40
    passages = [[rnd.choice(vocabulary) for _ in range(n)] for n in (19, 20, 21, 35, 60, 200)]
    docs = []
    for i in range(150):
        w = []
        for _ in range(rnd.randint(0, 6)):
            w += [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 15))]
            p = rnd.choice(passages)
            a = rnd.randint(0, 5)
            w += p[a : len(p) - rnd.randint(0, 5)]
        docs.append((i * 3 % 151, " ".join(w)))
    docs += [(1000, "x " * 300), (1001, "x " * 25), (1002, "x y " * 40), (1003, None), (1004, "")]
    got = substrings.remove_repeats(make(docs).repartition(7).withColumn("runs", F.lit(1)))
    assert as_repeats(got) == without_repeats(docs)


def test_repeated_passages_odd_rows(spark, make, odd_rows):
    docs = [d for k, d in enumerate(odd_rows) if d not in odd_rows[:k]]
    assert as_repeats(substrings.remove_repeats(make([*docs, (None, "left out")]))) == without_repeats(docs)
    assert substrings.remove_repeats(make([])).count() == 0


def grams(text, n=5):
    w = words(text)
    return frozenset(tuple(w[a : a + n]) for a in range(max(1, len(w) - n + 1))) if w else frozenset()


def classes(docs, threshold=0.8):
    sets = {i: grams(t) for i, t in docs}
    copies = defaultdict(list)
    for i, s in sets.items():
        copies[s if s else ("empty", i)].append(i)
    rep = {i: min(held) for held in copies.values() for i in held}
    reps = sorted(set(rep.values()))
    links, parent = defaultdict(int), {i: i for i in reps}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(reps):
        for b in reps[k + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (top(rep[i]), rep[i], links[rep[i]]) for i in sets}


def as_classes(df):
    return {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in df.collect()}


def test_repeated_passages_of_common_phrases(make, monkeypatch):
    """Phrases of any frequency met by window, and groups confirmed a few rows at a time."""
    monkeypatch.setattr(substrings, "SAMPLED", 1)
    monkeypatch.setattr(substrings, "COMMON", 3)
    monkeypatch.setattr(substrings, "HELD_ROWS", 7)
    rnd = random.Random(5)
    shared = [" ".join(f"s{k}w{j}" for j in range(rnd.randint(15, 40))) for k in range(6)]
    docs = [(i, " ".join([*(f"o{i}x{j}" for j in range(rnd.randint(0, 9))), rnd.choice(shared), *(f"p{i % 7}x{j}" for j in range(rnd.randint(0, 30))), rnd.choice(shared)])) for i in range(200)]
    docs += [(900, "the " * 120), (901, "a b " * 60)]
    assert len(substrings.common_phrases(make(docs), 20)) > 20
    assert as_repeats(substrings.remove_repeats(make(docs).repartition(5))) == without_repeats(docs)


def test_a_line_in_very_many_documents_is_no_hot_key(spark):
    """20,000 documents share a line of 24 words in surroundings of their own."""
    line = " ".join(f"line{j}" for j in range(24))
    words_of = "concat_ws(' ', transform(sequence(1, {n}), j -> concat('{c}', id, 'x', j)))"
    docs = spark.range(0, 20_000, 1, 8).selectExpr("id AS doc_id", f"concat({words_of.format(n=12, c='a')}, ' {line} ', {words_of.format(n=12, c='b')}) AS text")
    common = substrings.common_phrases(docs, 20)
    rows = substrings.candidates(docs, 20, common).where("first_doc IS NULL").groupBy("key").count()
    assert len(common) >= 1 and rows.agg(F.max("count")).first()[0] < 300
    removed = substrings.remove_repeats(docs, with_text=False).groupBy("n_removed").count().collect()
    assert {(r.n_removed, r["count"]) for r in removed} == {(24, 19_999), (0, 1)}


def test_near_copies_query(spark, sf, documents):
    assert as_classes(op5_ngram_join(spark, sf)) == classes([(d.doc_id, d.text) for d in documents])


@pytest.fixture(scope="module")
def near_docs():
    rnd = random.Random(9)
    docs = []
    for base in range(12):
        w = [f"b{base}w{rnd.randint(0, 400)}" for _ in range(rnd.choice([6, 30, 120, 400]))]
        for _ in range(rnd.choice([1, 2, 40])):
            v = list(w)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                v[rnd.randrange(len(v))] = f"e{rnd.random()}"
            docs.append((len(docs) * 7 % 1009, " ".join(v)))
    return [*docs, (2000, "too short"), (2001, "too  short"), (2002, ""), (2003, None), (2004, "")]


def test_near_copies_planted(spark, make, near_docs, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)  # many blocks
    got = near.near_copies(make(near_docs).repartition(5).withColumn("family", F.lit(1)).withColumn("size", F.lit(1)))
    assert as_classes(got) == classes(near_docs)


def test_near_copies_blocks_of_sizes(spark, make, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "BLOCK_MOST", 8)
    monkeypatch.setattr(near, "BLOCK_BYTES", 4000)
    rnd = random.Random(12)
    w = [f"c{k}" for k in range(120)]
    docs = [(i, " ".join(w[rnd.randint(0, 12) : 120 - rnd.randint(0, 60)])) for i in range(200)]
    for threshold in (0.8, 0.9, 0.5):
        assert as_classes(near.near_copies(make(docs).repartition(5), threshold=threshold)) == classes(docs, threshold)


def test_near_copies_blocks_stay_small(spark):
    sets = spark.range(20_000).select(F.col("id").alias("rep"), F.lit(1).cast("long").alias("family"), (F.col("id") % 100 * 30 + 50).cast("int").alias("n"))
    met = near._block_pairs(sets, "rep", "family", 0.8)
    held = met.groupBy("i", "j").agg(F.count("*").alias("rows"), F.sum(F.col("n") * 8).alias("bytes")).agg(F.max("rows").alias("rows"), F.max("bytes").alias("bytes")).first()
    assert held.rows < 2 * 1.3 * near.BLOCK_MOST and held.bytes < 2 * 1.3 * near.BLOCK_BYTES
    pairs = met.groupBy("i", "j").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    assert pairs.where("least < 0.8 * 0.8 * 0.8 * most").count() == 0  # only neighbouring classes of size meet


def test_loose():
    assert all(near.loose(t, 120) <= 2 * t - 1 for t in (0.1, 0.5, 0.8, 0.9, 1.0))
    assert near.loose(0.8, 120) < 0.4 and near.loose(0.95, 120) > 0.6


def test_keep_one(spark, make, near_docs):
    docs = make([*near_docs, near_docs[0]])
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (top, _, _) in classes(near_docs).items() if i == top)
    assert near.keep_one(make([])).count() == 0


def test_keep_one_null_and_repeated_ids(spark, make):
    text = lambda k: " ".join(f"t{k}w{j}" for j in range(60))
    docs = [(None, text(0)), (None, text(0)), (None, None), (1, text(0)), (2, text(0)), (3, text(1)), (3, text(2)), (3, text(2)), (4, text(2)), (5, text(3)), (6, text(3)), (6, text(4))]
    kept = [(r.doc_id, r.text) for r in near.keep_one(make(docs)).collect()]
    assert sorted(kept, key=repr) == sorted([(None, text(0)), (None, text(0)), (None, None), (1, text(0)), (3, text(1)), (3, text(2)), (5, text(3)), (6, text(4))], key=repr)


def test_banding():
    bands, rows = near.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= near.HASHES
    assert near.banding(1.0, 0.99) == (1, 16)


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(60)]
    parent = {}

    def top(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: top(i) for i in parent if top(i) != i}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_patience_is_a_rising_common_run():
    rnd = random.Random(3)
    for _ in range(2000):
        a, b = ([rnd.randint(0, 8) for _ in range(rnd.randint(0, 12))] for _ in range(2))
        found = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
    assert lines.patience(list("abcdXefg"), list("abYcdefgZ")) == [(0, 0), (1, 1), (2, 3), (3, 4), (5, 5), (6, 6), (7, 7)]
    assert len(lines.patience([7] * 50, [7] * 50)) == 50


UNSPACED = re.compile("[\u3400-\u9fff\u3040-\u30ff\u0e00-\u0e7f]")


def weight(line):
    many = (len(line.encode()) - len(line)) * 4 >= len(line)
    return max(len(words(line)), len(UNSPACED.findall(line)) // 2 if many else 0)


def leads(cut, least=lines.MIN_WORDS):
    """What leads to pairs: (text, lines) of heavy lines and of runs of lighter ones."""
    full = [k for k, line in enumerate(cut) if weight(line)]
    for n, k in enumerate(full):
        total = 0
        for j in full[n:]:
            total += weight(cut[j])
            if total >= least:
                yield tuple(cut[k : j + 1]), range(k, j + 1)
                break


def aligned_with(mine, other, least=lines.MIN_WORDS):
    gone, block = set(), []
    for p in [*lines.patience(mine, other), (-9, -9)]:
        if block and p != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(min(weight(mine[x]), least) for x, _ in block) >= least:
                gone |= {x for x, _ in block}
            block = []
        block.append(p)
    return gone


def check_aligned(rows, docs):
    """Against alignment with every earlier document that shares a lead: nothing else goes, and no lead that goes there stays."""
    cut = {i: t.split("\n") for i, t in docs if t is not None}
    rows = {r.doc_id: r for r in rows}
    holders, lost, removed = defaultdict(list), 0, 0
    for i in sorted(cut):
        mine, partners = cut[i], set()
        for text, _ in leads(mine):
            partners |= set(holders[text])
        each = [aligned_with(mine, cut[e]) for e in partners]
        every = set().union(*each)
        r = rows[i]
        kept = r.text.split("\n") if r.n_removed < len(mine) else []
        assert r.n_removed <= len(every) and r.n_lines == len(mine)
        # What is left is what stays in order; lines that go are among those that some earlier document aligns.
        must = set().union(*(set(at) for text, at in leads(mine) if any(set(at) <= gone for gone in each)))
        assert r.n_removed >= len(must), i
        more = Counter(kept) - Counter(x for k, x in enumerate(mine) if k not in every)
        assert len(kept) == len(mine) - r.n_removed and all(weight(x) < lines.MIN_WORDS for x in more)
        removed += r.n_removed
        lost += len(every) - r.n_removed
        for text, _ in leads(mine):
            holders[text].append(i)
    for i, t in docs:
        if t is None:
            assert rows[i].text is None and rows[i].n_removed == 0
    return removed, lost


def test_aligned_lines_query(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    removed, lost = check_aligned(op7_line_dedup(spark, "/root/testdata/sf0.01").collect(), [(d.doc_id, d.text) for d in docs.collect()])
    assert removed > 1000 and lost <= 3


@pytest.mark.parametrize("rare", [2, lines.RARE])
def test_aligned_lines_planted(spark, make, monkeypatch, rare):
    monkeypatch.setattr(lines, "RARE", rare)
    rnd = random.Random(6)
    pool = [" ".join(f"l{k}t{j}" for j in range(rnd.randint(1, 9))) for k in range(40)] + ["", "Et.", "}"]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, docs[3][1])]
    df = make(docs).withColumn("lines", F.lit(1)).withColumn("at", F.lit(1)).withColumn("leads", F.lit(1)).withColumn("h", F.lit(1))
    result = lines.remove_aligned(df)
    assert {*df.columns} <= {*result.columns}
    removed, lost = check_aligned(result.collect(), docs)
    assert removed > 100 and lost < removed // 10


def test_short_and_unspaced_lines_lead_too(make):
    poem, code = "a b\nc d\ne f\ng h\ni j", "}\n\n  return x;\n}\nelse {\n  y();\n}"
    chinese = "这个句子里没有任何空格可以用来分词\n第二个句子也是这样写出来的没有空格"
    docs = [(1, poem), (2, poem), (3, code), (4, "int z;\n" + code), (5, chinese), (6, chinese), (7, "a b\nc d"), (8, "a b\nc d"), (9, "c d\ne f\ng h")]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.remove_aligned(make(docs)).collect()}
    assert got[2] == ("", 5) and got[4] == ("int z;", 7) and got[6] == ("", 2)
    assert got[8] == ("a b\nc d", 0)  # four words in all lead to no pair
    assert got[9] == ("", 3)


def test_a_line_of_very_many_documents_costs_few_pairs(spark, make, monkeypatch):
    """3,000 documents share a line among words of their own; 300 copies of one text; a line that never aligns."""
    tried = []
    real = lines._align
    monkeypatch.setattr(lines, "_align", lambda pairs, *rest: tried.append(pairs.count()) or real(pairs, *rest))
    licence = "all rights are reserved by the authors of this text"
    docs = [(i, f"own words of text {i} are here\n{licence}\nand {i} more are at its end") for i in range(3000)]
    docs += [(5000 + i, "one two three four five\nsix seven eight nine ten\nand so on it all goes") for i in range(300)]
    docs += [(7000 + i, f"first line of {i} says this\n{licence}\nmiddle of {i} says that\n{licence}\nlast line of {i} ends") for i in range(60)]
    got = {r.doc_id: r for r in lines.remove_aligned(make(docs)).collect()}
    assert all(got[i].n_removed == 1 and licence not in got[i].text for i in range(1, 3000))
    assert got[0].n_removed == 0 and got[5000].n_removed == 0 and all(got[5000 + i].text == "" for i in range(1, 300))
    assert sum(tried) < 3 * len(docs)


def test_aligned_lines_odd_rows(spark, make, odd_rows):
    result = lines.remove_aligned(make([*odd_rows, (None, "no id")])).collect()
    assert len(result) == len(odd_rows) + 1
    assert {r.doc_id: r.text for r in result}[7] == ""
    assert {r.doc_id: r.text for r in result}[None] == "no id"
    assert lines.remove_aligned(make([])).count() == 0


def brute_leaks(docs, items, threshold=0.5, overlap=0.5):
    """Scores of all passages for all items, one by one."""
    fold = lambda t: [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t or "")]
    entries = [(i, w[a : a + decontaminate.ENTRY]) for i, w in ((i, fold(t)) for i, t in items) for a in range(0, len(w), decontaminate.ENTRY)]
    whole = {i: fold(t) for i, t in items}
    n, mean = len(entries), np.mean([len(w) for _, w in entries])
    df = defaultdict(int)
    for _, w in entries:
        for t in set(w):
            df[t] += 1
    weights = []
    for _, w in entries:
        made = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(w)}
        weights.append({t: x / sum(made.values()) for t, x in made.items()})

    def grams(w):
        k = max(1, min(3, len(w)))
        return {tuple(w[a : a + k]) for a in range(len(w) - k + 1)}, k

    out = set()
    for d, text in docs:
        w = fold(text)
        for start in range(-decontaminate.ENTRY, len(w), decontaminate.ENTRY):
            terms = set(w[max(0, start) : start + 2 * decontaminate.ENTRY])
            for (i, _), weight in zip(entries, weights, strict=True):
                if sum(weight.get(t, 0) for t in terms) >= threshold - 1e-9:
                    item = whole[i]
                    cut = len(item) - max(1, len(item) // 3) if len(item) > 1 else 0
                    base = max(0, start)
                    run = w[max(0, base - len(item)) : base + 2 * decontaminate.ENTRY + len(item)]
                    found = []
                    for part in (item[:cut], item[cut:]):
                        wanted, k = grams(part)
                        have = {tuple(run[a : a + k]) for a in range(len(run) - k + 1)}
                        found.append(len(wanted & have) / len(wanted) if wanted else 1.0)
                    if min(found) >= overlap:
                        out.add((d, i))
    return out


@pytest.mark.parametrize("items_of_a_shard", [3, 10**6])
def test_scores_do_not_depend_on_shards(spark, make, monkeypatch, items_of_a_shard):
    """Partial copies whose scores lie around the threshold, against all items at once."""
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", items_of_a_shard)
    rnd = random.Random(11)
    vocabulary = [f"t{i}" for i in range(80)] + ["the", "of"] * 20
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 150)))) for i in range(25)]
    docs = [(i, " ".join(w for w in rnd.choice(items)[1].split() if rnd.random() < rnd.choice([0.7, 0.9, 1])) + " x" * rnd.randint(0, 40)) for i in range(250)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(make(docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_leaks(docs, items) and len(found) > 60
    whole = decontaminate.Index(items, 0.5)
    for r in found:
        for _, hashes, before, _, _ in decontaminate.word_hashes(pa.array([docs[r.doc_id][1]]), decontaminate.letters_and_digits(), fold=True):
            best = {int(whole.item[item]): score for _, item, _, score, *_ in decontaminate.leaks(whole, hashes, before, 0.5)}
        assert abs(best[r.item_id] - r.score) < 1e-9


def test_leaks_query(spark, sf, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op1_decontamination(spark, sf).collect()}
    assert got == brute_leaks([(d.doc_id, d.text) for d in documents], items)
    assert got


def test_leaks_planted(spark, make, odd_rows):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 5)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 10, 40, 40, 63, 64, 65, 200, 500])]
    docs = []
    for k in range(60):
        w = [word() for _ in range(rnd.choice([0, 5, 70, 300]))]
        i, item = rnd.choice(items)
        part = item.split()
        if k % 3 == 0:
            part = part[: len(part) // 2]
        at = rnd.randint(0, len(w))
        docs.append((k, " ".join(w[:at] + part + w[at:])))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items] + [(99, None, "x"), (98, "", None)], "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(make(docs), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks(docs, items)
    clean = decontaminate.decontaminate(make([*docs, (None, "no id")]), bench)
    leaked = {d for d, _ in brute_leaks(docs, items)}
    assert sorted(r.doc_id for r in clean.where("doc_id is not null").collect()) == [d for d, _ in docs if d not in leaked]
    assert clean.where("doc_id is null").count() == 1
    assert decontaminate.contaminated(make(odd_rows), bench.limit(0)).count() == 0
    assert decontaminate.contaminated(make([]), bench).count() == 0
