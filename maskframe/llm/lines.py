"""Line dedup by pairwise alignment: blocks of lines that an earlier document has too go from the later one.

What leads documents to each other are lines of some weight, and runs of neighbouring
short lines that reach it together.  A rare one, held by up to ``RARE`` documents, leads
every holder to all earlier ones.  A common one leads its holders to others in the
order of what stands around it: documents whose common lines follow each other in the
same way are one kind, and the first document of each kind stands for it, because only
what two documents share bears on how they are aligned, and what they share beyond
common lines is rare.  Each pair is aligned by patience diff on all its lines, and the
aligned lines go from the later document.  A line that is still there although an
earlier document holds it is tried against further kinds, four times as many in each
round, until none is left untried, so a line that very many documents share costs a
few pairs for each of them, and none is given up.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.store import stage
from maskframe.operators.ranks import ranked

#: Words (or twice as many letters of scripts without spaces) that a line or a run of lines needs to lead to a pair, and a block to go.
MIN_WORDS = 5
#: A line that more documents hold is common.
RARE = 16
#: Kinds of holders of a common line that the first round tries, and how many times more each further one.
FIRST_KINDS, MORE_KINDS = 2, 4
#: Letters of scripts that put no spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two lists: equal ends, then the longest rising run of what is unique in both, and so on in between."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        of_a, of_b = Counter(a[i:m]), Counter(b[j:n])
        where = {x: k for k, x in enumerate(b[j:n], j) if of_b[x] == 1}
        unique = [(k, where[x]) for k, x in enumerate(a[i:m], i) if of_a[x] == 1 and x in where]
        # Longest run with rising positions in b: the last of each length, and who came before.
        ends, at, back = [], [], []
        for k, (_, y) in enumerate(unique):
            place = bisect_left(ends, y)
            ends[place : place + 1], at[place : place + 1] = [y], [k]
            back.append(at[place - 1] if place else -1)
        k, run = at[-1] if at else -1, []
        while k >= 0:
            run.append(unique[k])
            k = back[k]
        for x, y in run:  # from the last to the first
            todo.append((x + 1, m, y + 1, n))
            m, n = x + 1, y + 1
        # Each gap but the first begins behind an anchor and takes in the next one at its end.
        if run:
            todo.append((i, m, j, n))
    return sorted(set(out))


def _with_lines(docs: DataFrame) -> DataFrame:
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    return docs.withColumn("lines", lines)


def _words(line, most: int):
    """Number of words of a line, or ``most`` if it has more; long lines are not read to their end."""
    many = rf"^[ \t-\r]*(?:[^ \t-\r]+[ \t-\r]+){{{most - 1}}}[^ \t-\r]"
    return F.when(line.rlike(many), most).otherwise(F.size(F.regexp_extract_all(line, F.lit(r"[^ \t-\r]+"), F.lit(0))))


def _weight(line, most: int):
    """Words of a line, or half its letters of scripts without spaces, if that is more; at most ``most``.

    Such letters have three bytes; a line with few bytes more than characters is not searched for them.
    """
    letters = F.length(line) - F.length(F.regexp_replace(line, UNSPACED, ""))
    many = (F.octet_length(line) - F.length(line)) * 4 >= F.length(line)
    unspaced = F.when(many, F.least(F.floor(letters / 2).cast("int"), F.lit(most)))
    return F.greatest(_words(line, most), F.coalesce(unspaced, F.lit(0)))


def hashed_lines(docs: DataFrame, least: int) -> DataFrame:
    """Per document: hashes and weights of its lines, and ``leads``: (hash, first line, last line) of all that leads to pairs.

    A line of enough weight leads by itself; from a lighter one that is not blank a run of lines
    goes on, blank ones apart, until it has enough.
    """
    lines = _with_lines(docs.select("doc_id", "text")).select(
        "doc_id",
        F.transform("lines", lambda x: F.xxhash64(x, F.lit(1))).alias("lines"),
        F.transform("lines", lambda x: _weight(x, least).cast("int")).alias("words"),
    )
    # Positions of lines with words; every one of them weighs 1 at least, so a run has at most ``least``.
    full = lines.withColumn("full", F.expr("filter(sequence(0, size(words) - 1), i -> words[i] > 0)"))
    near = f"slice(full, k + 1, {least})"
    sums = f"transform({near}, (i, n) -> struct(i, aggregate(slice({near}, 1, n + 1), 0, (a, j) -> a + words[j]) AS w))"
    end = f"get(filter({sums}, s -> s.w >= {least}), 0).i"
    run = f"transform(sequence(0, size(full) - 1), k -> struct(full[k] AS a, CASE WHEN words[full[k]] >= {least} THEN full[k] ELSE {end} END AS b))"
    runs = full.withColumn("runs", F.expr(f"CASE WHEN size(full) > 0 THEN filter({run}, r -> r.b IS NOT NULL) ELSE CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>) END"))
    lead = "transform(runs, r -> struct(CASE WHEN r.a = r.b THEN xxhash64(lines[r.a]) ELSE xxhash64(slice(lines, r.a + 1, r.b - r.a + 1), 2) END AS h, r.a AS a, r.b AS b))"
    return runs.select("doc_id", "lines", "words", F.expr(lead).alias("leads"))


def _holders(hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``h``, ``doc_id`` of what several documents hold: the rare, and the common with the places (``a``, ``b``, last line ``z``) of each."""
    held = hashed.select("doc_id", F.explode(F.array_distinct(F.transform("leads", lambda x: x["h"]))).alias("h"))
    often = stage(held.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared-lines")
    rare = held.join(often.where(F.col("n") <= RARE).select("h"), "h")
    places = hashed.select("doc_id", F.size("lines").alias("z"), F.explode("leads").alias("l")).select("doc_id", "z", "l.h", "l.a", "l.b")
    return rare, stage(places.join(often.where(F.col("n") > RARE).select("h"), "h"), "common-lines")


def _rare_pairs(rare: DataFrame) -> DataFrame:
    """All pairs of the at most ``RARE`` holders of a line."""
    listed = rare.groupBy("h").agg(F.array_sort(F.collect_list("doc_id")).alias("d"))
    both = "flatten(transform(d, (x, i) -> transform(slice(d, 1, i), y -> struct(x AS later, y AS earlier))))"
    return listed.select(F.explode(F.expr(both)).alias("p")).select("p.later", "p.earlier").distinct()


def _kinds(common: DataFrame) -> DataFrame:
    """``h``, ``rep``, ``rank``: the first document of each kind that holds a common line, numbered by document."""
    rows = common.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "h"))).alias("c"), F.first("z").alias("z"))
    # What follows what, what else stands between or at the ends, but not where or how much.
    step = "transform(c, (x, i) -> struct(x.h, CASE WHEN i = 0 THEN x.a = 0 ELSE x.a <= c[i - 1].b + 1 END))"
    kind = rows.select("doc_id", F.xxhash64(F.expr(step), F.expr("element_at(c, -1).b = z - 1")).alias("kind"))
    reps = kind.groupBy("kind").agg(F.min("doc_id").alias("rep")).select("rep")
    held = common.select(F.col("doc_id").alias("rep"), "h").distinct().join(reps, "rep")
    return stage(ranked(held, ["h"], ["rep"]), "kinds")


GONE = pa.schema([("doc_id", pa.int64()), ("at", pa.list_(pa.int32()))])


def _align(pairs: DataFrame, hashed: DataFrame, least: int) -> DataFrame:
    """``doc_id`` and the positions ``at`` of the lines that go from the later documents of pairs."""
    mine = hashed.select(F.col("doc_id").alias("later"), "lines", "words")
    sides = hashed.select(F.col("doc_id").alias("earlier"), F.col("lines").alias("other"))
    both = pairs.join(mine, "later").join(sides, "earlier").select("later", "lines", "words", "other")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, gone = [], []
            for later, lines, words, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, block = [], []
                for i, j in [*patience(lines, other), (-1, -1)]:
                    if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                        if sum(words[x] for x, _ in block) >= least:
                            at += [x for x, _ in block]
                        block = []
                    block.append((i, j))
                if at:
                    ids.append(later)
                    gone.append(at)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], schema=GONE)

    found = both.mapInArrow(align, "doc_id long, at array<int>")
    return found.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))


def aligned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id`` and the positions ``at`` (from 0) of its lines that go; only documents that lose some."""
    hashed = stage(hashed_lines(docs, min_words), "line-hashes")
    rare, common = _holders(hashed)
    tried = stage(_rare_pairs(rare), "line-pairs")
    gone = stage(_align(tried, hashed, min_words), "aligned")
    kinds = _kinds(common)
    known = kinds.groupBy("h").agg(F.max("rank").alias("kinds"), F.min("rep").alias("first"))
    # Lines that an earlier document holds and that may still be there.
    left = common.join(known.select("h", "first"), "h").where("doc_id > first").select("doc_id", "h", "a", "b")
    low, high = 1, FIRST_KINDS
    while True:
        # Of every such line, those of whose places not all have gone.
        stays = "size(array_except(sequence(a, b), coalesce(at, CAST(array() AS ARRAY<INT>)))) > 0"
        left = stage(left.join(gone, "doc_id", "left").where(stays).select("doc_id", "h", "a", "b"), "left-lines")
        some = left.select("doc_id", "h").distinct().join(known.where(F.col("kinds") >= low).select("h", "kinds"), "h")
        ranks = some.select("doc_id", "h", F.explode(F.sequence(F.lit(low), F.least("kinds", F.lit(high)))).alias("rank"))
        found = ranks.join(kinds, ["h", "rank"]).where("rep < doc_id").select(F.col("doc_id").alias("later"), F.col("rep").alias("earlier"))
        new = stage(found.distinct().join(tried, ["later", "earlier"], "left_anti"), "line-pairs")
        if some.isEmpty():
            break
        if not new.isEmpty():
            tried = stage(tried.unionByName(new), "tried")
            both = gone.unionByName(_align(new, hashed, min_words))
            gone = stage(both.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")), "aligned")
        low, high = high + 1, high * MORE_KINDS
    return gone


def remove_aligned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without the lines that are aligned with an earlier document, and how many ``n_lines`` and ``n_removed``.

    Earlier means a smaller ``doc_id`` (unique; rows with a null one stay as they
    are).  What is aligned is judged on the input.  A document whose lines have fewer than
    ``min_words`` words in all leads to no pair, and a block of fewer stays.  A text all of whose lines go
    becomes empty; a null text stays null and has no lines.  Other columns stay.
    """
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gone = aligned(known, min_words).select(F.col("doc_id").alias("__aligned_doc"), F.col("at").alias("__aligned_at"))
    # Lines that go are known by place; the text is cut into lines only where some go.
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__aligned_at", i)), "\n")
    # Positions grow with the documents: a merge join at every size.
    joined = docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == F.col("__aligned_doc"), "left")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    columns = [docs[c] if c != "text" else F.when(F.col("__aligned_at").isNull(), F.col("text")).otherwise(kept).alias("text") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, n.alias("n_lines"), F.coalesce(F.size("__aligned_at"), F.lit(0)).cast("long").alias("n_removed"))
