"""Line dedup by pairwise alignment of overlapping documents.

1. Each text's lines (parted by \\n) become 64-bit hashes; blank lines have none.
2. Two kinds of keys find overlaps. A line that 2 to `rare` texts hold is rare and
   a key by itself, and so is a long line (LONG_WORDS words or LONG_BYTES bytes) at
   any frequency. Lines of any frequency are keys in pairs: two neighbouring
   lines (blank ones skipped) that two texts share, or a text's only line with its
   borders; so groups of thousands of copies, whose lines are not rare, are found
   too, while lone boilerplate lines are not.
3. Each key links its documents to the first one (least doc_id) that holds it; a
   document is then compared with every first document of its keys. With `every`,
   a key of `rare` holders or fewer links each of them to every earlier one, as
   the first may hold the shared parts in another order. More frequent keys link
   to the first one only, so links stay linear; where it has another order, a
   block that a later holder shares in the same order stays.
4. A patience diff aligns the line hashes of each linked pair: lines unique in both
   anchor it (longest increasing subsequence), the gaps between anchors are
   aligned alike, and without unique lines repeated ones count by occurrence.
5. An aligned block is a run of lines consecutive in both (blank lines between
   ignored). Blocks with a rare or long line, or of two lines or more, or that are a whole
   text, are deleted from the later document. All pairs are judged on the input; the first
   holder of a line keeps it, so no line is lost from the corpus.

Nulls: a null text has no lines; a row with a null doc_id is kept as it is.
Rows with one doc_id: neither is later, so they do not touch each other; a row's
deletions go by doc_id and text. Extra columns stay, whatever their names; those
called like a result give way to it. A very long text is a row like any other: its
line hashes travel, and the diff takes memory in proportion to its lines. An empty
table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import textkit
from faultline.llm.checkpoints import cut
from faultline.llm.columns import set_aside
from faultline.llm.textkit import U, mix

RARE = 20
MIN_BLOCK = 2
#: A line of so many words, or so many bytes where blanks are few, is long.
LONG_WORDS, LONG_BYTES = 20, 120
_PAIR, _ONE = U(0x9FB21C651E98DF25), U(0xD1B54A32D192ED03)
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_VALUES = textkit.STYLES["space"][1].copy()
_VALUES[[9, 11, 12, 13, 32]] = [U(0x5851F42D4C957F2D), U(0x14057B7EF767814F), U(0x2545F4914F6CDD1D), U(0x6C8E9CF570932BD5), U(0x94D049BB133111EB)]
textkit.STYLES["line"] = (_NEWLINE, _VALUES)


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row the numbers (from 0) and hashes of its lines with a word; a hash's last bit tells whether the line is long."""
    starts, ends, at = textkit.spans(data, offsets, "line")
    if not len(starts):
        return [(np.zeros(0, np.int64), np.zeros(0, U))] * (len(offsets) - 1)
    h = textkit.hashes(data, starts, ends, "line")
    ink = ~textkit.STYLES["space"][0][data]
    inked = np.append(0, np.cumsum(ink))
    solid = inked[ends] > inked[starts]
    opens = ink.copy()
    opens[1:] &= ~ink[:-1]
    opens[starts] = ink[starts]
    opened = np.append(0, np.cumsum(opens))
    long = (opened[ends] - opened[starts] >= LONG_WORDS) | (ends - starts >= LONG_BYTES)
    h = h & ~U(1) | long.astype(U)
    breaks = np.append(0, np.cumsum(data == 10))
    out = []
    for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        use = np.arange(a, b)[solid[a:b]]
        out.append((breaks[starts[use]] - breaks[offsets[r]], h[use]))
    return out


@textkit.lean
def _lines(batches):
    for batch in batches:
        data, offsets = textkit.buffers(batch.column("text"))
        numbers: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        for i, j in textkit.slices(offsets):
            for n, h in line_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                numbers.append(n)
                hashes.append(h)
        ends = np.append(0, np.cumsum([len(x) for x in hashes])).astype(np.int32)
        flat = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((numbers, np.int64), (hashes, U))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[0].astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[1].astype(U).view(np.int64)))],
            names=["doc_id", "tag", "numbers", "lines"],
        )


@textkit.lean
def _keys(batches):
    """Distinct keys of each row: single lines (pair false) and neighbours (pair true)."""
    for batch in batches:
        ids, lists = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("lines")
        flat = np.asarray(lists.values)
        at = np.asarray(lists.offsets)
        who, key, pair = [], [], []
        for doc_id, a, b in zip(ids, at[:-1], at[1:], strict=True):
            h = flat[a:b].view(U)
            if not len(h):
                continue
            one = np.unique(h)
            two = np.unique(mix(h[:-1] * _PAIR + h[1:])) if len(h) > 1 else mix(h ^ _ONE)
            who.append(np.full(len(one) + len(two), doc_id))
            key += [one, two]
            pair.append(np.append(np.zeros(len(one), bool), np.ones(len(two), bool)))
        if key:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who).astype(np.int64)), pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(pair))], names=["doc_id", "key", "pair"])


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence with rising second members; the first ones rise already."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            ends.append(i)
        else:
            tops[k], ends[k] = y, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b) of equal members, both rising."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        places: dict[int, int] = {}
        for i in range(a0, a1):
            places[a[i]] = -1 if a[i] in places else i
        seen: dict[int, int] = {}
        for j in range(b0, b1):
            seen[b[j]] = -1 if b[j] in seen else j
        unique = sorted((i, seen[x]) for x, i in places.items() if i >= 0 and seen.get(x, -1) >= 0)
        if unique:
            anchors = _rising(unique)
            i0, j0 = a0, b0
            for i, j in [*anchors, (a1, b1)]:
                if i > i0 and j > j0:
                    todo.append((i0, i, j0, j))
                i0, j0 = i + 1, j + 1
            out += anchors
        else:
            count: dict[int, int] = {}
            nth: dict[tuple[int, int], int] = {}
            for i in range(a0, a1):
                count[a[i]] = count.get(a[i], 0) + 1
                nth[a[i], count[a[i]]] = i
            count = {}
            pairs = []
            for j in range(b0, b1):
                count[b[j]] = count.get(b[j], 0) + 1
                i = nth.get((b[j], count[b[j]]))
                if i is not None:
                    pairs.append((i, j))
            out += _rising(sorted(pairs))
    return sorted(out)


def blocks(a: list[int], b: list[int], rare: set[int], least: int) -> list[int]:
    """Positions of b in the aligned blocks to delete."""
    gone: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-5, -5)]:
        if run and (i, j) != (last[0] + 1, last[1] + 1):
            if len(run) >= least or len(run) == len(b) or any(b[k] in rare for k in run):
                gone += run
            run = []
        run.append(j)
        last = (i, j)
    return gone


@textkit.lean
def _align(batches, least: int):
    for batch in batches:
        rows: list[list] = [[], [], []]
        for doc_id, tag, numbers, lines, first, rare in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "numbers", "lines", "first_lines", "rare")), strict=True):
            gone = blocks(first, lines, set(rare or ()), least)
            if gone:
                for column, value in zip(rows, (doc_id, tag, [numbers[k] for k in gone]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.list_(pa.int32()))], names=["g_id", "g_tag", "gone"])


def dedup_lines(docs: DataFrame, rare: int = RARE, min_block: int = MIN_BLOCK, every: bool = False) -> DataFrame:
    """The rows of docs with `kept_text` (null if the text is null), `n_lines` and `n_removed` (lines, blank ones not counted) added."""
    apart, back = set_aside(docs, {"tag__", "lines__", "gone__", "n__", "c_id__", "c_tag__", "g_id", "g_tag"}.__contains__)
    tagged = apart.withColumn("tag__", F.xxhash64("text"))
    lines = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("tag")).mapInArrow(_lines, "doc_id long, tag long, numbers array<int>, lines array<long>"))
    judged = lines.where("doc_id is not null and size(lines) > 0")
    keys = judged.select("doc_id", "lines").mapInArrow(_keys, "doc_id long, key long, pair boolean")
    first = (
        keys.groupBy(F.col("key").alias("k"), F.col("pair").alias("p"))
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("df"))
        .where(F.expr(f"first < last and (p or df <= {int(rare)} or k & 1 = 1)"))
        .select("k", "p", "first", "df")
    )
    held = keys.join(first, (F.col("key") == F.col("k")) & (F.col("pair") == F.col("p")))
    met = held.where("doc_id > first").select("doc_id", "first", "key", "pair", "df")
    if every:
        few = held.where(F.col("df") <= rare).groupBy("key", "pair").agg(F.collect_set("doc_id").alias("holders"))
        each = few.select("key", "pair", "holders", F.explode("holders").alias("doc_id"))
        earlier = each.select("doc_id", F.explode(F.filter("holders", lambda f: f < F.col("doc_id"))).alias("first"), "key", "pair")
        met = met.where(F.col("df") > rare).drop("df").unionByName(earlier)
    linked = met.groupBy(F.col("doc_id").alias("d"), F.col("first").alias("f")).agg(F.collect_set(F.when(~F.col("pair"), F.col("key"))).alias("rare"))
    of_first = judged.groupBy(F.col("doc_id").alias("f_id")).agg(F.min_by("lines", F.struct("tag", F.size("lines"))).alias("first_lines"))
    pairs = linked.join(judged, F.col("d") == F.col("doc_id")).join(of_first, F.col("f") == F.col("f_id"))
    found = pairs.select("doc_id", "tag", "numbers", "lines", "first_lines", "rare").mapInArrow(lambda batches: _align(batches, min_block), "g_id long, g_tag long, gone array<int>")
    gone = found.groupBy("g_id", "g_tag").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    counts = lines.groupBy(F.col("doc_id").alias("c_id__"), F.col("tag").alias("c_tag__")).agg(F.max(F.size("lines")).alias("n__"))
    extra = counts.join(gone, (F.col("c_id__") == F.col("g_id")) & (F.col("c_tag__") == F.col("g_tag")), "left").select("c_id__", "c_tag__", "n__", F.col("gone").alias("gone__"))
    joined = tagged.join(extra.hint("merge"), (F.col("doc_id") == F.col("c_id__")) & (F.col("tag__") == F.col("c_tag__")), "left")
    parted = joined.withColumn("lines__", F.when(F.col("gone__").isNotNull(), F.split(F.col("text"), "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines__") - 1), F.col("gone__"))
    kept = F.array_join(F.transform(left, lambda i: F.col("lines__")[i]), "\n")
    results = ["kept_text", "n_lines", "n_removed"]
    made = parted.select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in apart.columns if c.lower() not in results],
        F.when(F.col("gone__").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        F.coalesce("n__", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.when(F.col("gone__").isNotNull(), F.size("gone__")), F.lit(0)).cast("long").alias("n_removed"),
    )
    return made.select(*[c for name, c in back.items() if name.lower() not in results], *results)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = dedup_lines(docs, every=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
