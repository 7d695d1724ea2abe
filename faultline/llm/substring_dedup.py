"""Removal of word passages that an earlier document also holds, by recompression.

Every document is recompressed in rounds: runs of one word get one symbol, then
neighbouring pairs of symbols (left from one half of the alphabet, right from the
other) get one symbol. Names and alphabet halves come from hashes of content, so
all tasks name alike without exchanging a dictionary, and the symbols inside
equal passages are equal but for a few at the passage's borders. A symbol's
*context* is the span of words that its existence depends on; where the context
lies inside a window of `window` words, every equal window holds that symbol too.

Each window is filed under one symbol, chosen from its content alone: of the
highest-level symbols whose context it holds, the one of least hash. Runs of
windows with one symbol travel as one row, under the name of the context (64
bits), each window with its offset and a 32-bit print: 96 bits decide equality.
A task first settles what repeats within each of its batches, so a hot passage
costs a row per batch, not per document. Rows of one name then meet, sorted by
document; the first document with a window keeps it, later ones learn which
words they lose.

Nulls: a null text has no words; a row with a null doc_id neither removes nor
loses anything. A very long text is read whole, with memory in proportion to its
length. Rows with one doc_id: neither is smaller, so they do not touch
each other. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import textkit
from faultline.llm.textkit import U, mix

WINDOW = 13
ROUNDS = 2
_RUN, _PAIR, _HALF, _NAME, _PRINT = (U(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))
_LOC = 1 << 31


def recompress(word: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, rounds: int):
    """Levels of (names, context start, context end), words counted over the whole slice.

    doc: each word's row; first, last: its row's first word and the one after its last.
    At a text's edge a context reaches past the edge, so no window holds it.
    """
    at = np.arange(len(word))
    levels = [(word, at, at + 1)]
    # Runs: a word's fate depends on both neighbours.
    head = np.ones(len(word), bool)
    head[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], len(word))
    size = (end - begin).astype(U)
    name = np.where(size > U(1), mix(word[begin] ^ size * _RUN), word[begin])
    rows = doc[begin]
    low, high = begin - 1, end + 1  # before a text's first word and after its last lies a foreign one
    low = np.where(begin == first[begin], begin - 1 - len(word), low)
    high = np.where(end == last[begin], end + 1 + len(word), high)
    for _ in range(rounds):
        left = (mix(name ^ _HALF) & U(1)) == U(0)
        near = np.zeros(len(name), bool)  # has a right neighbour in its text
        near[:-1] = rows[1:] == rows[:-1]
        pair = np.zeros(len(name), bool)
        pair[:-1] = near[:-1] & left[:-1] & ~left[1:]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # An unpaired left symbol depends on its right neighbour, a right one on its left one; a pair on itself.
        beyond = np.append(high[1:], 0)
        before = np.append(0, low[:-1])
        prior = np.append(False, near[:-1])
        to = np.where(pair | (left & near), beyond, np.where(left, high + len(word), high))
        fro = np.where(~left & prior, before, np.where(left, low, low - len(word)))
        joined = np.append(mix(name[:-1] * _PAIR ^ mix(name[1:] + _PAIR)), U(0)) if len(name) else name
        keep = ~second
        name, low, high, rows = np.where(pair, joined, name)[keep], np.where(pair, low, fro)[keep], to[keep], rows[keep]
        # contexts nest from left to right
        levels.append((name, low, high))
    return levels


def choose(levels, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window its symbol's context: start and end."""
    at, upto = np.full(len(starts), -1), np.full(len(starts), -1)
    open_ = np.arange(len(starts))
    for name, low, high in reversed(levels):
        if not len(open_):
            break
        lo, hi = np.maximum.accumulate(low), np.minimum.accumulate(high[::-1])[::-1]
        p = starts[open_]
        a, b = np.searchsorted(lo, p, "left"), np.searchsorted(hi, p + window, "right")
        best, which = np.full(len(p), U(0xFFFFFFFFFFFFFFFF)), np.full(len(p), -1)
        rank = mix(name ^ _NAME)
        j = 0
        while True:
            k = a + j
            live = np.flatnonzero(k < b)
            if not len(live):
                break
            k = k[live]
            fits = (low[k] >= p[live]) & (high[k] <= p[live] + window)
            better = fits & (rank[k] < best[live])
            best[live[better]] = rank[k[better]]
            which[live[better]] = k[better]
            j += 1
        got = which >= 0
        at[open_[got]], upto[open_[got]] = low[which[got]], high[which[got]]
        open_ = open_[~got]
    return at, upto


def windows_of(word: np.ndarray, offsets: np.ndarray, window: int, rounds: int):
    """(start, name, offset of the symbol, print) of every window; starts counted over the slice."""
    counts = np.diff(offsets)
    doc = np.repeat(np.arange(len(counts)), counts)
    first, last = offsets[:-1][doc], offsets[1:][doc]
    starts = np.flatnonzero(np.arange(len(word)) + window <= last)
    if not len(starts):
        return starts, np.zeros(0, U), starts, np.zeros(0, np.uint32), doc
    at, upto = choose(recompress(word, doc, first, last, rounds), starts, window)
    up, down = textkit.powers(len(word) + 1)
    total = np.zeros(len(word) + 1, U)
    np.cumsum(word * up[: len(word)], out=total[1:])
    name = mix((total[upto] - total[at]) * down[at] ^ (upto - at).astype(U) * _NAME)
    prints = (mix(textkit.ngrams(word, window)[starts] ^ _PRINT) >> U(32)).astype(np.uint32)
    return starts, name, at - starts, prints, doc


_SENT = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("loc", pa.int64()), ("body", pa.binary())])
_SENT_DDL = "key long, doc_id long, loc long, body binary"


def _owners(name, offset, prints, doc_id):
    """Least doc_id of each window over the arrays given: (key of each window, its least doc_id)."""
    key = mix(name ^ mix(prints.astype(U) + offset.astype(U) * _PRINT))
    order = np.lexsort((doc_id, key))
    k, d = key[order], doc_id[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    least = np.empty(len(k), np.int64)
    least[order] = d[head][np.cumsum(head) - 1]
    return key, least


@textkit.lean
def _file(batches, window: int, rounds: int):
    """Rows to send: windows by name, and, by document, windows known to be repeats already (body empty name: key of the place)."""
    for batch in batches:
        data, offsets = textkit.buffers(batch.column("text"))
        ids = batch.column("doc_id")
        valid = ~np.asarray(ids.is_null())
        ids = ids.fill_null(0).to_numpy()
        tags = batch.column("tag").to_numpy()
        for i, j in textkit.slices(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, to = textkit.spans(part, at, "space")
            begin, name, offset, prints, doc = windows_of(textkit.hashes(part, starts, ends, "space"), to, window, rounds)
            row = doc[begin] + i
            ok = valid[row]
            begin, name, offset, prints, row = begin[ok], name[ok], offset[ok], prints[ok], row[ok]
            if not len(begin):
                continue
            _, least = _owners(name, offset, prints, ids[row])
            known = least < ids[row]
            pos = begin - to[row - i]
            cut = np.ones(len(begin), bool)
            cut[1:] = (begin[1:] != begin[:-1] + 1) | (row[1:] != row[:-1]) | (known[1:] != known[:-1]) | (~known[1:] & (name[1:] != name[:-1])) | (~known[1:] & (offset[1:] != offset[:-1] - 1))
            head = np.flatnonzero(cut)
            size = np.diff(np.append(head, len(begin)))
            loc = pos[head] * _LOC + tags[row[head]]
            place = mix(ids[row[head]].view(U) * _PAIR ^ loc.view(U))
            key = np.where(known[head], place, name[head])
            # body: byte 0 is the first window's offset; for repeats -1 and the count of windows
            lead = np.where(known[head], 255, offset[head]).astype(np.uint8)
            width = np.where(known[head], 4, 4 * size) + 1
            ends_ = np.cumsum(width)
            body = np.zeros(int(ends_[-1]), np.uint8)
            body[ends_ - width] = lead
            words = prints.copy()
            words[head[known[head]]] = size[known[head]].astype(np.uint32)
            use = ~known
            use[head] = True
            inside = np.ones(len(body), bool)
            inside[ends_ - width] = False
            body[inside] = words[use].astype("<u4").view(np.uint8)
            marks = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(np.append(0, ends_).astype(np.int32)), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row[head]]), pa.array(loc), marks], schema=_SENT)


_MARKS_DDL = "doc_id long, loc long, bits binary"
_MARKS = pa.schema([("doc_id", pa.int64()), ("loc", pa.int64()), ("bits", pa.binary())])


@textkit.lean
def _meet(batches):
    """Rows sorted by key and document -> for each row with repeats, a byte per window: 1 if an earlier document has it."""
    held_name, held_key, held_least = None, np.zeros(0, U), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = textkit.buffers(batch.column("body"))
        keys, ids, loc = (batch.column(c).to_numpy() for c in ("key", "doc_id", "loc"))
        lead = data[offsets[:-1]]
        known = lead == 255
        inside = np.ones(len(data), bool)
        inside[offsets[:-1]] = False
        values = np.ascontiguousarray(data[inside]).view("<u4")
        size = (np.diff(offsets) - 1) // 4
        at = np.cumsum(size) - size
        for r in np.flatnonzero(known):
            yield _one(ids[r], loc[r], int(values[at[r]]))
        row = np.repeat(np.arange(len(size)), size)
        step = np.arange(len(values)) - at[row]
        live = ~known[row]
        row, step, prints = row[live], step[live], values[live]
        if not len(row):
            continue
        name = keys[row].view(U)
        key, least = _owners(name, lead[row].astype(np.int64) - step, prints, ids[row])
        if held_name is not None:
            mine = np.flatnonzero(name == held_name)
            if len(mine) and len(held_key):
                k = np.minimum(np.searchsorted(held_key, key[mine]), len(held_key) - 1)
                same = held_key[k] == key[mine]
                least[mine[same]] = np.minimum(least[mine[same]], held_least[k[same]])
        again = least < ids[row]
        rows = np.unique(row[again])
        if len(rows):
            bits = again.astype(np.uint8)
            take = np.zeros(len(size), bool)
            take[rows] = True
            body = bits[take[row]]
            lengths = size[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]), pa.array(loc[rows]), pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.py_buffer(body)])],
                schema=_MARKS,
            )
        # the last name may go on in the next batch
        tail = name == name[-1]
        fresh_key, fresh_least = key[tail], least[tail]
        if held_name is not None and held_name == name[-1]:
            fresh_key, fresh_least = np.append(held_key, fresh_key), np.append(held_least, fresh_least)
        held_name = name[-1]
        order = np.lexsort((fresh_least, fresh_key))
        fresh_key, fresh_least = fresh_key[order], fresh_least[order]
        head = np.ones(len(fresh_key), bool)
        head[1:] = fresh_key[1:] != fresh_key[:-1]
        held_key, held_least = fresh_key[head], fresh_least[head]


def _one(doc_id, loc, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([loc]), pa.array([b"\1" * n], pa.binary())], schema=_MARKS)


_OUT_DDL = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


@textkit.lean
def _cut(batches, window: int, texts: bool):
    for batch in batches:
        ids, data, marks = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("marks").to_pylist()
        rows: list[list] = [[], [], [], [], []]
        for doc_id, text, mark in zip(ids, data, marks, strict=True):
            word = (text or "").encode().split()
            n = len(word)
            if mark:
                edge = np.zeros(n + window + 1, np.int64)
                for loc, bits in zip((x["loc"] for x in mark), (x["bits"] for x in mark), strict=True):
                    p = loc // _LOC + np.flatnonzero(np.frombuffer(bits, np.uint8))
                    np.add.at(edge, p, 1)
                    np.add.at(edge, p + window, -1)
                gone = np.cumsum(edge[:n]) > 0
                word = [w for w, g in zip(word, gone.tolist(), strict=True) if not g]
            kept = b" ".join(word)
            for column, value in zip(rows, (doc_id, n, n - len(word), kept.decode() if texts else None, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (null unless `texts`), kept_sha256 of each row.

    window: words of the shortest repeat, at most 254.
    """
    if not 5 <= window <= 254:
        raise ValueError("window must be from 5 to 254 words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.pmod(F.xxhash64("text"), F.lit(_LOC)).alias("tag"))
    sent = rows.mapInArrow(lambda batches: _file(batches, window, rounds), _SENT_DDL)
    met = sent.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_meet, _MARKS_DDL)
    marks = (
        met.withColumn("tag", F.pmod("loc", F.lit(_LOC)))
        .groupBy(F.col("doc_id").alias("m_id"), F.col("tag").alias("m_tag"))
        .agg(F.collect_list(F.struct("loc", "bits")).alias("marks"))
    )
    joined = rows.join(marks, (F.col("doc_id") == F.col("m_id")) & (F.col("tag") == F.col("m_tag")), "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(lambda batches: _cut(batches, window, texts), _OUT_DDL)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select r, doc_id, p, md5(array_to_string(w[p : p + 12], ' ')) as h from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as p from d where len(w) >= 13)),
f as (select h, min(doc_id) as least from g group by h having min(doc_id) < max(doc_id)),
gone as (select r, list(distinct q) as qs from (select r, unnest(range(p, p + 13)) as q from g join f using (h) where doc_id > least) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(qs), 0) as bigint) as n_removed,
  sha256(case when qs is null then array_to_string(w, ' ') else array_to_string(list_filter(w, lambda x, i: not list_contains(qs, i)), ' ') end) as kept_sha256
from d left join gone using (r)
"""
