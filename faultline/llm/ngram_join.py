"""Near duplicates by n-gram Jaccard similarity, found with MinHash bands.

1. A document's set holds the hashes of its runs of five words (white space parts
   words, A-Z are lower-cased); of one to four words, the whole text is its only
   member. Equal sets (two 64-bit sums over their members and their size agree) are
   one node, whatever doc_ids hold them; one text stands for it.
2. Rows per band and the number of bands follow from the threshold and the target
   recall: as many rows as the number of hashes allows. Nodes are shuffled on band
   hashes; each is linked to the least node of each of its buckets, not to
   all of them, and connected components of these links are candidate groups:
   every pair that shares any bucket lies within one group.
3. Each group is verified on full sets, all against all: in blocks of bounded size,
   each pair of blocks a task's unit of work, by counting common members. Only
   counts of links and a spanning forest leave a block, never the pairs.
4. Components of the verified links are the classes.

Copies never enter step 3 but through their node. No bucket, group or
partner count is capped. The work of step 3 is quadratic in the number of
*different* texts of one candidate group, spread over blocks, as each of their
links has to be counted.

Result per row: doc_id, class_id (least doc_id of its class), rep_id (least doc_id
with the same set), n_links (other sets at the threshold or above). Nulls: a null
or wordless text is a class of its own. A row with a null doc_id takes part only
as a copy of others: without any, class_id and rep_id are null. Rows of one doc_id
with different texts are judged each for itself: where two classes have the same
least doc_id, the one of least node carries it as class_id, the others carry their
node (a 64-bit hash). Repeated rows are copies. A very long text is one set like any
other: a task holds 16 bytes for each of its words. Ties can't arise: a
similarity of exactly the threshold is a link. Extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import textkit
from faultline.llm.checkpoints import cut
from faultline.llm.columns import set_aside
from faultline.llm.components import components
from faultline.llm.textkit import U, mix

N = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 150
BLOCK_GRAMS = 1_000_000
BLOCK_TEXTS = 600
_SHORT, _SECOND, _BAND = (U(x) for x in (0xD6E8FEB86659FD93, 0xA3EC647659359ACD, 0xC2B2AE3D27D4EB4F))


def bands_for(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective bands that reach the recall at the threshold."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p)) if p > 1e-12 else max_hashes + 1
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for the recall")
    return best


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    starts, ends, at = textkit.spans(data, offsets, "space_folded")
    word = textkit.hashes(data, starts, ends, "space_folded")
    gram = textkit.ngrams(word, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(gram[a : b - n + 1]))
        elif b > a:
            out.append(mix(textkit.ngrams(word[a:b], b - a, 7) ^ (np.array([b - a], U) * _SHORT)))
        else:
            out.append(np.zeros(0, U))
    return out


@textkit.lean
def _sign(batches, n: int, bands: int, rows: int):
    """Size, two sums and the bands of each row's set; a batch for each slice of texts, whose sets then go."""
    rnd = np.random.Generator(np.random.PCG64(77))
    factor = rnd.integers(0, 1 << 63, bands * rows, dtype=U) * U(2) + U(1)
    shift = rnd.integers(0, 1 << 63, bands * rows, dtype=U)
    seed = np.arange(1, bands + 1, dtype=U) * _BAND
    for batch in batches:
        data, offsets = textkit.buffers(batch.column("text"))
        for i, j in textkit.slices(offsets, textkit.CHUNK):
            sets = gram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            key, sums = np.zeros((len(sets), bands), U), np.zeros((2, len(sets)), U)
            if len(full):
                flat = np.concatenate(sets)
                head = (np.cumsum(size) - size)[full]
                sums[0, full] = np.add.reduceat(mix(flat), head)
                sums[1, full] = np.add.reduceat(mix(flat ^ _SECOND), head)
                for b in range(bands):
                    h = np.full(len(full), seed[b])
                    for r in range(b * rows, (b + 1) * rows):
                        h = mix(h * factor[0] + np.minimum.reduceat((flat ^ shift[r]) * factor[r], head))
                    key[full, b] = h
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(size) * bands + 1, bands, dtype=np.int32)), pa.array(key.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), batch.column("tag").slice(i, j - i), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), listed],
                names=["doc_id", "tag", "n", "h1", "h2", "bands"],
            )


def common(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of a's sets with b's, or with each other."""
    sets = a if b is None else a + b
    n, m = len(a), len(a) if b is None else len(b)
    base = 0 if b is None else n
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    head = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    size = np.diff(np.append(head, len(flat)))
    out = np.zeros((n, m), np.float32)
    # Rare members: pair by pair.
    few = 24
    rare = np.repeat((size >= 2) & (size < few), size)
    r_owner = owner[rare]
    r_group = np.repeat(np.arange(len(size)), size)[rare]
    cells = []
    for d in range(1, few - 1):
        same = np.flatnonzero(r_group[d:] == r_group[:-d]) if len(r_group) > d else np.zeros(0, int)
        if not len(same):
            break
        x, y = r_owner[same].astype(np.int64), r_owner[same + d].astype(np.int64)
        if b is not None:
            cross = (x < n) & (y >= n)
            x, y = x[cross], y[cross]
        cells.append(x * m + y - base)
    if cells:
        cell = np.concatenate(cells)
        if len(cell):
            out += np.bincount(cell, minlength=n * m).reshape(n, m).astype(np.float32)
    # Frequent members: products of 0/1 matrices.
    often = np.flatnonzero(size >= few)
    for k in range(0, len(often), 2048):
        part = often[k : k + 2048]
        take = np.repeat(head[part], size[part]) + np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        who, column = owner[take], np.repeat(np.arange(len(part)), size[part])
        grid = np.zeros((len(sets), len(part)), np.float32)
        grid[who, column] = 1
        product = grid[:n] @ grid[base:].T
        out += np.triu(product, 1) if b is None else product
    return out


def links(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold; above the diagonal only, where b is None."""
    shared = common(a, b).astype(np.float64)
    na = np.array([len(s) for s in a], float)
    nb = na if b is None else np.array([len(s) for s in b], float)
    linked = (shared > 0) & (shared >= threshold * (na[:, None] + nb[None, :] - shared) - 1e-9)
    return np.triu(linked, 1) if b is None else linked


def _labels(linked: np.ndarray) -> np.ndarray:
    """Component of each row of a symmetric link matrix: the least row."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


_FOUND_DDL = "a long, b long, n_links long"


def _block(members: list[tuple[int, int, str]], first: int, second: int, n: int, threshold: float):
    """Rows of one block pair: counts (a, null, n_links) and forest links (a, b, null)."""
    sides = [[m for m in members if m[0] == s] for s in ((first,) if first == second else (first, second))]
    sets = []
    for side in sides:
        own: list[np.ndarray] = []
        for m in side:
            raw = np.frombuffer(m[2].encode(), np.uint8)
            own += gram_sets(raw, np.array([0, len(raw)]), n)
        sets.append(own)
    ids = np.array([m[1] for side in sides for m in side], np.int64)
    if not all(sets):
        return
    if len(sets) == 1:
        linked = links(sets[0], None, threshold)
        full = linked | linked.T
    else:
        linked = links(sets[0], sets[1], threshold)
        k = len(sets[0])
        full = np.zeros((len(ids), len(ids)), bool)
        full[:k, k:] = linked
        full[k:, :k] = linked.T
    count = full.sum(1)
    touched = np.flatnonzero(count)
    if not len(touched):
        return
    label = _labels(full)
    away = touched[label[touched] != touched]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([ids[touched], ids[away]])),
            pa.array([None] * len(touched) + ids[label[away]].tolist(), pa.int64()),
            pa.array(count[touched].tolist() + [None] * len(away), pa.int64()),
        ],
        names=["a", "b", "n_links"],
    )


@textkit.lean
def _verify(batches, n: int, threshold: float):
    key, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("component", "first", "second", "block", "node", "text")]
        for component, first, second, block, node, text in zip(*columns, strict=True):
            if (component, first, second) != key:
                if len(held) > 1:
                    yield from _block(held, key[1], key[2], n, threshold)
                key, held = (component, first, second), []
            held.append((block, node, text or ""))
    if len(held) > 1:
        yield from _block(held, key[1], key[2], n, threshold)


def _nodes(signed: DataFrame) -> DataFrame:
    """h1, h2, n, node, rep_id, rep_tag, bands of each set that a row with a doc_id holds.

    The node is h1; of different sets with one h1 (one in 2**64 pairs) all but the first get another hash.
    """
    sets = signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "tag")).alias("rep"), F.first("bands").alias("bands"))
    nth = F.row_number().over(Window.partitionBy("h1").orderBy("h2", "n"))
    named = sets.withColumn("nth", nth)
    return named.select("h1", "h2", "n", F.when(F.col("nth") == 1, F.col("h1")).otherwise(F.xxhash64("h1", "h2", "n")).alias("node"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.tag").alias("rep_tag"), "bands")


def _judge(docs: DataFrame, n: int, threshold: float, recall: float, max_hashes: int, block_grams: int, block_texts: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, n, h1, h2 of every row; h1, h2, n, rep_id, rep_tag, n_links, class of every set). class: its least node."""
    bands, rows = bands_for(threshold, recall, max_hashes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    signed = cut(texts.mapInArrow(lambda batches: _sign(batches, n, bands, rows), "doc_id long, tag long, n long, h1 long, h2 long, bands array<long>"))
    nodes = cut(_nodes(signed))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    hubs = keyed.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    stars = keyed.join(hubs, keyed.key == hubs.k).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    groups = components(stars).withColumnRenamed("node", "g_node")
    members = cut(groups.join(nodes.select("node", "rep_id", "rep_tag", "n"), F.col("g_node") == F.col("node")).select("component", "node", "rep_id", "rep_tag", "n"))
    blocks = members.groupBy(F.col("component").alias("c")).agg(F.greatest(F.ceil(F.sum("n") / block_grams), F.ceil(F.count("*") / block_texts)).cast("int").alias("blocks"))
    dealt = members.join(blocks, F.col("component") == F.col("c")).select("component", "node", "rep_id", "rep_tag", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    met = dealt.hint("merge").join(texts, (F.col("rep_id") == F.col("doc_id")) & (F.col("rep_tag") == F.col("tag")))
    held = met.groupBy("node", "component", "block", "blocks").agg(F.first("text").alias("text"))  # repeated rows hold it more than once
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = held.select("component", "node", "block", "text", other).select("component", "node", "block", "text", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    found = cut(
        paired.repartition("component", "first", "second").sortWithinPartitions("component", "first", "second").mapInArrow(lambda batches: _verify(batches, n, threshold), _FOUND_DDL)
    )
    counts = found.where("n_links is not null").groupBy(F.col("a").alias("l_node")).agg(F.sum("n_links").alias("n_links"))
    classes = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("c_node"), "component")
    linked = counts.join(classes, F.col("l_node") == F.col("c_node"), "full").select(F.coalesce("l_node", "c_node").alias("l_node"), "n_links", "component")
    known = nodes.drop("bands").join(linked, F.col("node") == F.col("l_node"), "left")
    return signed.drop("bands"), cut(known.select("h1", "h2", "n", "rep_id", "rep_tag", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "node").alias("class")))


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES, block_grams: int = BLOCK_GRAMS, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """doc_id, class_id, rep_id, n_links per row."""
    signed, known = _judge(docs, n, threshold, recall, max_hashes, block_grams, block_texts)
    least = known.groupBy("class").agg(F.min("rep_id").alias("least"))
    owner = least.groupBy(F.col("least").alias("o_id")).agg(F.min("class").alias("owner"))
    named = least.join(owner, F.col("least") == F.col("o_id")).select(F.col("class").alias("n_class"), F.when(F.col("class") == F.col("owner"), F.col("least")).otherwise(F.col("class")).alias("class_id"))
    sets = known.join(named, F.col("class") == F.col("n_class")).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("n").alias("rn"), "rep_id", "n_links", "class_id")
    joined = signed.join(sets, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("n") == F.col("rn")), "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep_id", "doc_id").alias("rep_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> DataFrame:
    """The rows of docs without near duplicates: of each class one row with its least doc_id stays.

    Rows with a null doc_id or without a word stay.
    """
    _, known = _judge(docs, n, threshold, recall, max_hashes, BLOCK_GRAMS, BLOCK_TEXTS)
    stay = known.groupBy("class").agg(F.min(F.struct("rep_id", "rep_tag")).alias("first")).select(F.col("first.rep_id").alias("nj__first"), F.col("first.rep_tag").alias("nj__of"))
    judged = F.coalesce(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
    docs, back = set_aside(docs, lambda c: c.startswith("nj__"))
    marked = docs.where(judged).withColumn("nj__id", F.col("doc_id").cast("long")).withColumn("nj__tag", F.xxhash64("text"))
    kept = marked.join(stay.hint("merge"), (F.col("nj__id") == F.col("nj__first")) & (F.col("nj__tag") == F.col("nj__of")), "left_semi")
    return kept.dropDuplicates(["nj__id", "nj__tag"]).drop("nj__id", "nj__tag").unionByName(docs.where(~judged)).select(*back.values())


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)
