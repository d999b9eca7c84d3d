"""Trained models on held-out rows, fingerprints, chat formatting and the pipeline."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from maskframe.llm import chat, fingerprint, language, toxicity
from maskframe.llm.queries import op3_fingerprints, op8_toxicity, op9_language, op10_chat
from maskframe.llm.words import letters_and_digits, word_hashes

SF = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_rows(spark):
    rows = op8_toxicity(spark, SF).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    by = defaultdict(Counter)
    for r in rows:
        if r.held_out and label.get(r.doc_id) is not None:
            by[lang[r.doc_id]][label[r.doc_id], r.predicted] += 1
    tried = sum(by.values(), Counter())
    assert tried[1, 1] / (tried[1, 1] + tried[1, 0]) >= 0.9
    assert tried[0, 1] / (tried[0, 0] + tried[0, 1]) < 0.02
    # Here 300 toxic texts are learned from: 21 of them Spanish, 45 German, 42 French.
    for name, least in (("en", 0.9), ("de", 0.8), ("fr", 0.85), ("es", 0.6)):
        assert by[name][1, 1] / (by[name][1, 1] + by[name][1, 0]) >= least, (name, by[name])
        assert by[name][0, 1] / (by[name][0, 0] + by[name][0, 1]) < 0.1, (name, by[name])


def test_unseen_misspelling_shares_grams(spark):
    clean, toxic = "this is a plain text about rivers and hills", "this is a plain text about idiot and hills"
    model = toxicity.fit([clean, toxic] * 40, [0, 1] * 40)
    found = []
    for _, hashes, before, _, place in word_hashes(pa.array(["about rivers", "about idiots", "about idiiot", "", None]), letters_and_digits(), fold=True):
        found += model.scores(hashes, before, place).tolist()
    assert found[0] < 0.5 < found[1] and found[2] > found[0]
    assert found[3] == found[4]


def test_toxicity_odd_rows(spark, make, odd_rows):
    docs = make([*odd_rows, *[(100 + i, f"bad scum {i}" if i % 2 else f"fine words {i}") for i in range(60)]]).withColumn("score", F.lit(1)).withColumn("toxic", F.lit(1))
    labels = spark.createDataFrame([(100 + i, None, i % 2) for i in range(60)] + [(100, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.classify(docs, labels).count() == len(odd_rows) + 60
    assert toxicity.keep_clean(docs, labels).columns == docs.columns
    for none in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        untaught = toxicity.classify(docs, none).collect()
        assert len(untaught) == len(odd_rows) + 60 and all(0 < r.score < 0.7 and r.predicted == 0 for r in untaught)
        assert toxicity.keep_clean(docs, none).count() == docs.count()
    assert toxicity.classify(make([]), labels).count() == 0


def test_language_on_held_out_rows(spark):
    rows = op9_language(spark, SF).collect()
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    tried = [r.lang_pred == known[r.doc_id] for r in rows if r.held_out and known[r.doc_id]]
    assert np.mean(tried) > 0.97


def test_language_odd_rows(spark, make, odd_rows):
    docs = make([*odd_rows, (20, "123 456 ,. "), (21, "é"), *[(100 + i, "the and of " * 9 if i % 2 else "der und die " * 9) for i in range(40)]])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") >= 100, F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))).withColumn("lang_pred", F.lit("x"))
    got = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    assert [got[i] for i in (1, 2, 3, 20)] == ["und"] * 4
    assert got[21] in ("en", "de")
    assert language.identify(make([])).count() == 0
    unknown = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(unknown) == docs.count() and all((r.lang_pred, r.score) == ("und", 0.0) for r in unknown)


def paragraphs(text):
    keys, before = fingerprint.digests(pa.array([text], pa.large_string()))
    return Counter(keys.tolist())


def likeness(a, b):
    x, y = paragraphs(a), paragraphs(b)
    return sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0


def edited(docs):
    docs = sorted((d for d in docs if d[0] is not None), key=lambda d: d[0])
    for k, (i, text) in enumerate(docs):
        text, later = text or "", docs[(k + 1) % len(docs)][1] or ""
        q = len(text) // 4
        yield i, text, text[: len(text) - q] + later[:q], later


def check_fingerprints(rows, docs):
    rows = {r.doc_id: r for r in rows}
    for i, text, other, later in edited(docs):
        r = rows.pop(i)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(text, other))
        assert r.near_next == pytest.approx(likeness(text, later))
    assert not rows


def test_fingerprints_query(spark, sf, documents):
    rows = op3_fingerprints(spark, sf).collect()
    check_fingerprints(rows, [(d.doc_id, d.text) for d in documents])
    by_text = defaultdict(set)
    texts = {d.doc_id: d.text for d in documents}
    for r in rows:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.85


def test_fingerprints_over_many_ranges(spark, make, odd_rows, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS", 3)
    docs = [d for k, d in enumerate(odd_rows) if d not in odd_rows[:k]] + [(100 * i, f"text {i}\n" * i) for i in range(1, 40)]
    frame = make([*docs, (None, "left out")]).withColumn("part", F.lit(1)).withColumn("extra", F.lit(1))
    check_fingerprints(fingerprint.compare_with_edited(frame.repartition(4)).collect(), docs)
    check_fingerprints(fingerprint.compare_with_edited(make([(5, "one only, nothing else")])).collect(), [(5, "one only, nothing else")])
    assert fingerprint.compare_with_edited(make([])).count() == 0
    assert fingerprint.compare_with_edited(make(odd_rows)).count() == len(odd_rows)


def test_peeling_recovers_what_differs():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 400, dtype=np.int64).view(np.uint64)
    for d in (0, 1, 7, 200):
        a, b = keys, keys[d:]
        found = fingerprint.likeness((a, np.array([0, len(a)])), (b, np.array([0, len(b)])))
        assert found[0] == pytest.approx((400 - d) / 400)


def test_template_is_reversible():
    texts = ["<|", "<\\|", "<\\\\|im_end|>", "a<|im_end|>\n<|im_start|>user\nb", "", "\\", "<", "|>", "<<||"]
    turns = [(r, t) for r in ["user", "assistant", "a\nb\\n<|x|>"] for t in texts]
    formatted, spans = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def check_chat(rows, turns):
    held = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda x: tuple((v is not None, v) for v in x)):
        held[c].append((role or "", text or ""))
    rows = {r.conv_id: r for r in rows}
    assert set(rows) == set(held)
    for c, said in held.items():
        r = rows[c]
        learned = "".join(t for role, t in said if role == "assistant")
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(said), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.formatted_chars == len(chat.format_turns(said)[0])


def test_chat_query(spark, sf):
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    check_chat(op10_chat(spark, sf).collect(), [*turns, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_chat_odd_rows(spark):
    turns = [(1, 0, "user", None), (1, 0, "user", None), (1, 5, None, "x"), (2, None, "assistant", ""), (None, 1, "assistant", "a\nb"), (3, 1, "assistant", "y" * 100_000)]
    turns += [(4, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(100)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1)).withColumn("node", F.lit(1))
    check_chat(chat.format_conversations(df.repartition(5)).collect(), turns)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_reply_trees(spark):
    rows = [(7, 1, None, "user", "q", 0.0), (7, 2, 1, "assistant", "bad", 0.1), (7, 3, 1, "assistant", "good", 0.9), (7, 4, 3, "user", "more", None), (7, 5, 4, "assistant", "x", 0.2), (7, 6, 4, "assistant", "y", 0.2), (8, 9, 77, "user", "orphan", None)]
    tree = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    found = defaultdict(list)
    for r in chat.paths(tree).collect():
        found[r.leaf].append((-r.up, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == {2: [1, 2], 5: [1, 3, 4, 5], 6: [1, 3, 4, 6], 9: [9]}
    best = {r.tree: [t for _, t in chat.read_turns(r.formatted)] for r in chat.format_trees(tree).collect()}
    assert best == {7: ["q", "good", "more", "x"], 8: ["orphan"]}
    assert chat.format_trees(tree, None).count() == 4 and chat.format_trees(tree, 2).count() == 3
    with pytest.raises(ValueError):
        chat.paths(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"))


def test_pipeline_stages(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs, seen = documents, []
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, sf), "test-stage")
        seen.append(docs)
        if name != "best-fit packing":
            assert docs.columns == documents.columns
    clean, unlined, single, tested, packed = seen
    toxic = {r.doc_id for r in op8_toxicity(spark, sf).where("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in documents.collect()} - toxic
    assert unlined.count() == clean.count()
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in tested.collect()}
    assert 0 < tested.count() <= single.count() <= unlined.count()
