"""Benchmark decontamination with one Aho-Corasick automaton (or several, one after another).

Benchmark texts are lower-cased (A-Z), reduced to words and cut into windows of
`window` consecutive words; a shorter item is one window. All windows go into
one automaton over numbers of words (those of no window are one number), which
scans each normalised document once. A hit's place gives its words, and their
places in the original text give character spans [start, end), counted in code
points from 0; the query returns them as `start-end`, comma-joined.

The items are broadcast; each worker process builds the automaton once and
keeps the last one. A window costs it about 0.8 KB. Items are cut into segments of a
bounded number of windows; a benchmark of more than `max_windows` is dealt to several
automata by a hash of its segments, and the documents are scanned once for each, one
automaton after another, so neither the driver nor a worker holds more than one. What
they hit is joined on document and text, and a last pass counts it as if one had found it.

Nulls: a null text has no words. An item without words is ignored; rows with a
null item_id are ignored. Repeated item_ids count as one item. Repeated rows and
texts of one doc_id are judged each for itself. A very long text is scanned whole, with
memory in proportion to its length. Empty tables give no hits or no rows; extra
columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import textkit
from faultline.llm.checkpoints import cut

WINDOW = 10


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(textkit.ALNUM_FOLD).split()


def windows(items: list[tuple[int, str]], window: int) -> tuple[dict[tuple[int, ...], list[int]], dict[bytes, int], list[int]]:
    """Window in word numbers -> numbers of the items that hold it; words' numbers, from 1; the item of each number."""
    ids = sorted({i for i, _ in items})
    number = {i: k for k, i in enumerate(ids)}
    words: dict[bytes, int] = {}
    found: dict[tuple[int, ...], list[int]] = {}
    for i, text in items:
        w = [words.setdefault(x, len(words) + 1) for x in normal_words(text)]
        for p in range(max(1, len(w) - window + 1)) if w else ():
            held = found.setdefault(tuple(w[p : p + window]), [])
            if number[i] not in held[-1:]:
                held.append(number[i])
    return found, words, ids


def _segments(batches, window: int, most: int):
    """Items' words, joined by blanks, in stretches of up to `most` windows."""
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = normal_words(text)
            starts = range(0, max(1, len(words) - window + 1), most) if words else ()
            parts = [words[p : p + most + window - 1] for p in starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(parts), pa.int64()), pa.array([max(1, len(w) - window + 1) for w in parts], pa.int64()), pa.array([b" ".join(w).decode() for w in parts], pa.string())],
                names=["item_id", "n_windows", "text"],
            )


def groups_of(benchmark: DataFrame, window: int, max_windows: int) -> list[DataFrame]:
    """(item_id, text) of the items' segments, in as many groups as keep to max_windows each."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    most = max(1, max_windows // 8)
    segments = cut(rows.mapInArrow(lambda batches: _segments(batches, window, most), "item_id long, n_windows long, text string").distinct())
    n = 1
    while True:
        placed = segments.withColumn("g", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        largest = placed.groupBy("g").agg(F.sum("n_windows").alias("w")).agg(F.max("w")).first()[0] or 0
        if largest <= max_windows:
            return [placed.where(F.col("g") == g).select("item_id", "text") for g in range(n)]
        n = max(n + 1, n * largest // max_windows)


#: The last automaton that this worker process built, by the broadcast's number and the window.
_BUILT: dict[tuple[str, int], tuple] = {}


def _automaton(token: str, items: list[tuple[int, str]], window: int) -> tuple:
    """(automaton, words' numbers, length and items of each window, item ids)"""
    if (token, window) not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        found, words, ids = windows(items, window)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, key in enumerate(found):
            automaton.add_word(key, k)
        if found:
            automaton.make_automaton()
        _BUILT[token, window] = automaton, words, [(len(key), who) for key, who in found.items()], ids
    return _BUILT[token, window]


@textkit.lean
def _scan(batches, token: str, sent, window: int, spans: bool):
    automaton, words, windows_, ids = _automaton(token, sent.value, window)
    known = words.get
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            text = text.as_py() or ""
            word = tuple([known(w, 0) for w in normal_words(text)])
            n, hit, items = len(word), 0, set()
            places: list[tuple[int, int]] = []
            found = list(automaton.iter(word)) if n and windows_ else []
            if found:
                edge = np.zeros(n + 1, np.int64)
                for last, k in found:
                    size, who = windows_[k]
                    edge[last + 1 - size] += 1
                    edge[last + 1] -= 1
                    items.update(who)
                covered = np.cumsum(edge[:n]) > 0
                hit = int(covered.sum())
                if spans:
                    places = original_spans(text, covered)
            for column, value in zip(out, (doc_id.as_py(), n, hit, [ids[k] for k in sorted(items)], [{"start": a, "end": b} for a, b in places]), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "n_words", "n_hit", "items", "spans"])


def original_spans(text: str, covered: np.ndarray) -> list[tuple[int, int]]:
    """Character spans [start, end) of the covered words' runs in the original text."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = textkit.spans(data, np.array([0, len(data)]), "alnum_folded")
    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    on = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in zip(np.flatnonzero(on == 1), np.flatnonzero(on == -1), strict=True)]


def _covered(n: int, runs: list[dict]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        edge[r["start"]] += 1
        edge[r["end"]] -= 1
    return np.cumsum(edge[:n]) > 0


@textkit.lean
def _runs(batches, token: str, sent, window: int):
    """(doc_id, tag, items, runs of covered words) of the texts that this automaton finds something in."""
    automaton, words, windows_, ids = _automaton(token, sent.value, window)
    known = words.get
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for doc_id, tag, text in zip(batch.column("doc_id"), batch.column("tag"), batch.column("text"), strict=True):
            word = tuple([known(w, 0) for w in normal_words(text.as_py())])
            found = [(last, *windows_[k]) for last, k in automaton.iter(word)] if word and windows_ else []
            if found:
                on = np.diff(np.concatenate([[0], _covered(len(word), [{"start": last + 1 - size, "end": last + 1} for last, size, _ in found]).astype(np.int8), [0]]))
                runs = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(on == 1), np.flatnonzero(on == -1), strict=True)]
                for column, value in zip(out, (doc_id.as_py(), tag.as_py(), sorted({ids[i] for _, _, who in found for i in who}), runs), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "tag", "items", "runs"])


@textkit.lean
def _settle(batches, spans: bool):
    """Words, hit words and character spans of each row, from the runs that all automata found."""
    for batch in batches:
        out: list[list] = [[], [], []]
        for text, runs in zip(batch.column("text"), batch.column("runs"), strict=True):
            text, runs = text.as_py() or "", runs.as_py() or []
            n = len(normal_words(text))
            covered = _covered(n, runs)
            places = original_spans(text, covered) if spans and runs else []
            for column, value in zip(out, (n, int(covered.sum()), [{"start": a, "end": b} for a, b in places]), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        n_words, n_hit, places = (pa.array(c, t) for c, t in zip(out, kinds, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_words, n_hit, batch.column("items"), places], names=["doc_id", "n_words", "n_hit", "items", "spans"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, spans: bool = True, max_windows: int = 250_000) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids found, ascending), spans (character ranges hit; empty unless `spans`)."""
    context, result = docs.sparkSession.sparkContext, "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start: long, end: long>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = groups_of(benchmark, window, max_windows)

    def send(group: DataFrame):
        return uuid.uuid4().hex, context.broadcast([(r[0], r[1]) for r in group.collect()])

    if len(groups) == 1:
        token, sent = send(groups[0])
        return rows.mapInArrow(lambda batches: _scan(batches, token, sent, window, spans), result)
    tagged = rows.withColumn("tag", F.xxhash64("text"))
    found = None
    for group in groups:
        token, sent = send(group)
        kind = "doc_id long, tag long, items array<long>, runs array<struct<start: long, end: long>>"
        one = cut(tagged.mapInArrow(lambda batches, token=token, sent=sent: _runs(batches, token, sent, window), kind).distinct())
        sent.unpersist()
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy(F.col("doc_id").alias("m_id"), F.col("tag").alias("m_tag")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))
    met = tagged.join(merged, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tag") == F.col("m_tag")), "left")
    return met.select("doc_id", "text", F.coalesce("items", F.array().cast("array<long>")).alias("items"), "runs").mapInArrow(lambda batches: _settle(batches, spans), result)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_leaks(docs, benchmark)
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), spans.alias("spans"))


ORACLE = r"""
with b as (select distinct item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark where text is not null and item_id is not null),
bw as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[p : p + 9], ' ') as g from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as p from b where len(w) > 0)),
d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
sizes as (select distinct k from bw),
dw as (select doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, sizes where len(w) >= k)),
m as (select dw.doc_id, dw.p, dw.k, bw.item_id from dw join bw on dw.g = bw.g and dw.k = bw.k),
hit as (select distinct doc_id, q from (select doc_id, unnest(range(p, p + k)) as q from m)),
h as (select doc_id, count(*) as n_hit from hit group by doc_id),
piece as (select doc_id, unnest(pieces) as x, unnest(range(1, len(pieces) + 1)) as q from (select doc_id, regexp_extract_all(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as pieces from documents where doc_id in (select doc_id from h))),
place as (select doc_id, q, x, cast(sum(length(x)) over (partition by doc_id order by q) as bigint) as stop from piece),
run as (select doc_id, q - row_number() over (partition by doc_id order by q) as island, stop - length(regexp_replace(x, '^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', '')) as start, stop from hit join place using (doc_id, q)),
s as (select doc_id, string_agg(a || '-' || b, ',' order by a) as spans from (select doc_id, min(start) as a, max(stop) as b from run group by doc_id, island) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as names from (select distinct doc_id, cast(item_id as varchar) as s from m) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(spans, '') as spans
from d left join h on d.doc_id = h.doc_id left join i on d.doc_id = i.doc_id left join s on d.doc_id = s.doc_id
"""
