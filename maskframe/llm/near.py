"""Near copies: Jaccard similarity of full n-gram sets, found by MinHash banding.

Documents with the same n-gram set are one class and go on as one row.  Bands
and rows are chosen for a target recall.  Within a bucket of a band, members are
compared by a sketch of all their minima: first each with the bucket's smallest
member, by joins, so that no bucket is ever brought together; what is not clearly
like that one is compared in blocks.  Sketch links only gather families; inside a
family every pair of blocks that sizes allow a link is verified exactly on the full
sets, as products of 0/1 matrices, so links are counted without a row for each.
Blocks have at most about ``BLOCK_MOST`` rows and ``BLOCK_BYTES`` of grams however large the
family is; what grows with it is the number of pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.components import components
from maskframe.llm.store import binary, ids_and_texts, stage
from maskframe.llm.words import mix, ranges, run_hashes, white_space, word_hashes

#: Hashes that a signature may have.
HASHES = 128
#: Rows in a block of a bucket or family: at least, and at most, about; between them as many as make ``BLOCKS`` blocks.
BLOCK, BLOCK_MOST, BLOCKS = 200, 1000, 32
#: Bytes of grams in a block, about; a set that is larger alone is a block.
BLOCK_BYTES = 4 << 20
#: Blocks of a size class are numbered below this.
_CLASS = 1 << 32


def banding(threshold: float, recall: float) -> tuple[int, int]:
    """Bands and rows: as many rows as the number of hashes allows for a pair at the threshold to share a band with that probability."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= HASHES:
            return bands, rows
    return HASHES, 1


def grams(hashes: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, sorted, and where each text's begin; a shorter text is one gram."""
    words = np.diff(before)
    counts = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    starts = ranges(before[:-1], counts)
    text = np.repeat(np.arange(len(words)), counts)
    found = run_hashes(hashes, starts, starts + np.minimum(n, words[text])) if len(starts) else np.zeros(0, np.uint64)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], np.concatenate(([0], np.cumsum(np.bincount(text[new], minlength=len(words)))))


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Per document: number of n-grams, two hashes of the set, band hashes, and a byte of every minimum."""
    k = bands * rows
    factor = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    shift = mix(np.arange(k + 1, 2 * k + 1, dtype=np.uint64))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, before, _, _ in word_hashes(batch.column(1), white_space()):
                found, bounds = grams(hashes, before, n)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                starts = bounds[:-1][full]
                low = np.zeros((len(full), k), np.uint32)
                h1, h2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
                if len(full):
                    for j in range(k):
                        low[:, j] = np.minimum.reduceat((found * factor[j] + shift[j]) >> np.uint64(32), starts)
                    h1[full] = np.add.reduceat(mix(found + np.uint64(1)), starts)
                    h2[full] = np.add.reduceat(mix(found ^ np.uint64(0x5DEECE66D)), starts)
                banded = run_hashes(low.astype(np.uint64).ravel() + np.uint64(1), *(np.arange(len(full) * bands) * rows + x for x in (0, rows))) if len(full) else np.zeros(0, np.uint64)
                banded = mix(banded + np.tile(np.arange(bands, dtype=np.uint64), len(full))).view(np.int64)
                counts = np.where(sizes > 0, 1, 0)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts * bands))).astype(np.int32)), pa.array(banded))
                sketch = binary(low.astype(np.uint8), counts, k)
                yield pa.record_batch([batch.column(0).slice(at, len(sizes)), pa.array(sizes.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), listed, sketch], schema=SIGNED)

    return docs.mapInArrow(make, "doc_id long, n int, h1 long, h2 long, bands array<long>, sketch binary")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bytes of sketches, less what equal by chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _sketches(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, k)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, which are sorted together; holds one group at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        key = [t[k].to_numpy() for k in keys]
        new = np.zeros(len(t), dtype=bool)
        for k in key:
            new[1:] |= k[1:] != k[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), len(t)]
        for a, b in zip(edges, edges[1:], strict=False):
            here = tuple(k[a] for k in key)
            if here != last and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(t.slice(a, b - a))
            last = here
    if held:
        yield pa.concat_tables(held).combine_chunks()


def loose(threshold: float, k: int) -> float:
    """Sketches of k minima less alike than this are not of one family.

    What is ``clear`` (2 * threshold - 1) with the first one may have a near copy that
    is as little as 3 * threshold - 2 like it; three standard errors of the sketch less.
    """
    like = max(3 * threshold - 2, 0)
    return 3 * threshold - 2 - 3 * math.sqrt(like * (1 - like) / k)


def _block_pairs(df: DataFrame, node: str, key: str, threshold: float) -> DataFrame:
    """Each row once for every pair of blocks that its block is in; ``i`` and ``j`` name the pair, ``mine`` the row's own block.

    ``n`` is the size of a row's set.  Where a key has more than one block, blocks are made
    within classes of size as wide as the threshold allows two near copies to differ,
    and meet those of their own class and the next ones only.  Keys of one row are left out.
    """
    wide = max(-math.log(threshold), 1e-6) * (1 + 1e-9)
    df = df.withColumn("cls", F.floor(F.log(F.col("n").cast("double")) / F.lit(wide)).cast("long"))
    counted = df.groupBy(key, "cls").agg(F.count("*").alias("size"), F.sum(F.col("n").cast("long") * 8).alias("bytes"))
    whole = counted.groupBy(key).agg(F.sum("size").alias("size"), F.sum("bytes").alias("bytes"), F.collect_list(F.struct("cls", "size", "bytes")).alias("parts")).where("size > 1")
    rows = f"least({BLOCK_MOST}, greatest({BLOCK}, ceil(size / {BLOCKS})))"
    parts = F.expr(f"map_from_entries(transform(parts, x -> struct(x.cls, greatest(ceil(x.size / {rows}), ceil(x.bytes / {BLOCK_BYTES})))))")
    whole = whole.select(key, F.when(F.expr(f"size > {BLOCK} or bytes > {BLOCK_BYTES}"), parts).alias("blocks"))
    df = df.join(stage(whole, "blocks"), key)
    mine = F.expr(f"cls * {_CLASS} + pmod(xxhash64({node}, {key}), blocks[cls])")
    others = F.expr(f"flatten(transform(filter(array(cls - 1, cls, cls + 1), c -> blocks[c] is not null), c -> sequence(c * {_CLASS}, c * {_CLASS} + blocks[c] - 1)))")
    df = df.withColumn("mine", F.when(F.col("blocks").isNull(), F.lit(0).cast("long")).otherwise(mine))
    df = df.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(others)))
    return df.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("blocks", "cls", "other")


def _sketch_links(reps: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """Links ``a``, ``b`` that put any two likely near copies into one family."""
    k = bands * rows
    clear = 2 * threshold - 1  # what is at least this much like the first one leaves none of its own near copies behind
    linking = loose(threshold, k)
    keyed = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = stage(keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("rep").alias("hub")).where("size > 1").drop("size"), "buckets")
    pairs = keyed.join(shared, "bucket").where("rep != hub")
    sketches = reps.select("rep", "sketch")
    pairs = pairs.join(sketches, "rep").join(sketches.select(F.col("rep").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                like = _alike(_sketches(batch.column(3), k), _sketches(batch.column(4), k))
                linked, left = like >= linking, like < clear
                b = pa.array(batch.column(2).to_numpy(), mask=~linked)
                kept = pa.array(linked | left)
                yield pa.record_batch([batch.column(0), batch.column(1), b, pa.array(left)], names=["bucket", "a", "b", "left"]).filter(kept)

    first = stage(pairs.select("bucket", "rep", "hub", "sketch", "hub_sketch").mapInArrow(compare, "bucket long, a long, b long, left boolean"), "firsts")
    left = stage(first.where("left").select("bucket", F.col("a").alias("rep")).join(reps.select("rep", "n"), "rep"), "left")
    left = _block_pairs(left, "rep", "bucket", threshold).join(sketches, "rep")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches, ["bucket", "i", "j"]):
            node, own = np.unique(group["rep"].to_numpy(), return_index=True)
            sketch, rest = _sketches(group["sketch"], k)[own], np.arange(len(node))
            label = rest.copy()  # only links that join two families go out, fewer than there are rows
            while len(rest) > 1:
                hub, rest = rest[0], rest[1:]
                like = _alike(sketch[rest], sketch[hub])
                linked = rest[like >= linking]
                joined, at = np.unique(label[linked], return_index=True)
                at = at[joined != label[hub]]
                if len(at):
                    a.append(node[linked[at]])
                    b.append(np.full(len(at), node[hub]))
                    label[np.isin(label, joined)] = label[hub]
                rest = rest[like < clear]
        if a:
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    rest = left.select("bucket", "i", "j", "rep", "sketch").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return first.where("b is not null").select("a", "b").unionByName(rest.mapInArrow(inside, "a long, b long"))


def _verified(texts: DataFrame, family: DataFrame, n: int, threshold: float) -> DataFrame:
    """Per row of a block pair: ``a``, its number of links in the pair ``n_links``, and the smallest document ``b`` that they lead to."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, before, _, _ in word_hashes(batch.column(1), white_space()):
                found, bounds = grams(hashes, before, n)
                yield pa.record_batch([batch.column(0).slice(at, len(bounds) - 1), binary(found.astype("<u8"), np.diff(bounds), 8)], names=["rep", "grams"])

    inside = texts.withColumnRenamed("doc_id", "rep").join(family.select("rep"), "rep").dropDuplicates(["rep"])
    with_sets = stage(inside.select("rep", "text").mapInArrow(sets, "rep long, grams binary"), "sets")
    # The sizes are those of the sets that are compared, also where an id has several texts.
    sized = family.join(with_sets.select("rep", F.expr("cast(octet_length(grams) div 8 as int)").alias("n")).where("n > 0"), "rep")
    rows = _block_pairs(stage(sized, "sized"), "rep", "family", threshold).join(with_sets, "rep")
    rows = rows.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, links = [], [], []
        for group in _groups(batches, ["family", "i", "j"]):
            node, mine = group["rep"].to_numpy(), group["mine"].to_numpy()
            held = [np.frombuffer(g, "<u8") for g in group["grams"].to_pylist()]
            inside = group["i"][0].as_py() == group["j"][0].as_py()
            left = np.arange(len(node)) if inside else np.flatnonzero(mine == group["i"][0].as_py())
            right = left if inside else np.flatnonzero(mine != group["i"][0].as_py())
            if len(left) and len(right) and len(node) > 1:
                linked = jaccard(held, left, right) >= threshold
                if inside:
                    np.fill_diagonal(linked, False)
                count = np.zeros(len(node), np.int64)
                count[left] += linked.sum(axis=1)
                if not inside:
                    count[right] += linked.sum(axis=0)
                label = _labels(linked, left, right, node)
                some = count > 0
                a.append(node[some])
                b.append(label[some])
                links.append(count[some])
        if a:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (a, b, links)], names=["a", "b", "n_links"])

    return rows.select("family", "i", "j", "mine", "rep", "grams").mapInArrow(pairs, "a long, b long, n_links long")


def jaccard(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, wide: int = 4096) -> np.ndarray:
    """Similarity of sets of left and right, exactly, from the grams that more than one set has."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    gram, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    used = counts[gram] > 1
    column, row = (np.cumsum(counts > 1) - 1)[gram[used]], row[used]
    shared = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [lo, lo + wide])
        has = np.zeros((len(sets), min(wide, int(column[-1]) + 1 - lo)), np.float32)
        has[row[a:b], column[a:b] - lo] = 1
        shared += has[left] @ has[right].T
    return shared / np.maximum(sizes[left][:, None] + sizes[right][None, :] - shared, 1)


def _labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The smallest node that each node reaches."""
    label, before = node.copy(), None
    most = np.iinfo(np.int64).max
    while before is None or (label != before).any():
        before = label.copy()
        label[left] = np.minimum(label[left], np.where(linked, label[right][None, :], most).min(axis=1))
        label[right] = np.minimum(label[right], np.where(linked, label[left][:, None], most).min(axis=0))
    return label


def near_copies(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """Group documents whose sets of n-word runs have a Jaccard similarity of ``threshold`` or more.

    Words are runs without white space, unchanged; a text of fewer than n words
    is one run.  Returns for every row ``doc_id``, ``class_id`` (smallest id of its
    connected group), ``copy_of`` (smallest id with the same set), ``n_links`` (number of
    other sets that its own is linked to).  Null and empty texts are linked to
    nothing.  A null ``doc_id`` is left out.  If rows with one id have different
    texts, one of the texts stands for the id as a representative.
    """
    bands, rows = banding(threshold, recall)
    texts = ids_and_texts(docs).where(F.col("doc_id").isNotNull())
    signed = stage(signatures(texts, n, bands, rows), "signatures")
    classes = stage(signed.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    member = signed.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))
    reps = signed.join(classes.select("h1", "h2", F.col("rep").alias("doc_id")), ["h1", "h2", "doc_id"]).select(F.col("doc_id").alias("rep"), "n", "bands", "sketch")
    reps = stage(reps.dropDuplicates(["rep"]), "representatives")
    gathered = components(_sketch_links(reps, bands, rows, threshold))
    family = stage(gathered.unionByName(gathered.select(F.col("component").alias("node"), "component").distinct()), "families")
    family = family.select(F.col("node").alias("rep"), F.col("component").alias("family"))
    links = stage(_verified(texts, family, n, threshold), "verified")
    found = components(links.select("a", "b")).withColumnRenamed("node", "rep")
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n_links").alias("n_links"))
    known = stage(counts.join(found, "rep", "left"), "linked")
    return member.join(known, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"), F.col("rep").alias("copy_of"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """The documents without near copies: of each group the one with the smallest id stays, with all its columns.

    Rows with a null id stay as they are.  Rows that repeat an id and its text are
    one, and one of them stays; different texts with one id are compared as any others.
    """
    text, key = F.coalesce(F.col("text").cast("string"), F.lit("")), "__near_key"
    doc, known = F.col("doc_id").cast("long"), docs.where(F.col("doc_id").cast("long").isNotNull())
    # Of an id with several texts the one with the smallest hash keeps it, the others get keys of their own.
    hashed = known.select(doc.alias("__near_doc"), F.xxhash64(text).alias("__near_hash"))
    several = stage(hashed.groupBy("__near_doc").agg(F.min("__near_hash").alias("__near_first"), F.max("__near_hash").alias("last")).where("__near_first < last").drop("last"), "repeated-ids")
    own = F.when(F.col("__near_first").isNull() | (F.xxhash64(text) == F.col("__near_first")), doc).otherwise(F.xxhash64(doc, F.xxhash64(text)))
    keyed = known.join(several, doc == F.col("__near_doc"), "left").withColumn(key, own).select(*docs.columns, key)
    extra = hashed.join(several, "__near_doc").where("__near_hash != __near_first")
    extra = stage(extra.select(F.xxhash64("__near_doc", "__near_hash").alias(key), "__near_doc").distinct(), "further-texts")
    copies = near_copies(keyed.select(F.col(key).alias("doc_id"), "text"), n, threshold, recall).withColumnRenamed("doc_id", key).join(extra, key, "left")
    kept = copies.groupBy("class_id").agg(F.min(F.struct(F.coalesce("__near_doc", key).alias("id"), F.col(key))).alias("least")).select(F.col(f"least.{key}"))
    # The ids that stay are nearly as many as the documents: a merge join at every size.
    held = stage(kept, "kept").hint("merge")
    whole = keyed.join(held, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    return whole.unionByName(docs.where(F.col("doc_id").cast("long").isNull()))
