"""Best-fit packing of tokenised documents, planned on the length histogram.

1. Each document is tokenised once, ended with id 0 and cut into pieces of at most
   `size` tokens; the pieces' lengths are kept (the ids only on request).
2. The histogram of lengths has at most `size` rows however many documents there
   are; it goes to the driver, where best-fit decreasing runs over counts: all
   sequences of one fill level are one group, and a placement fills many at once.
   The plan is a list of runs (length, first rank, count, first sequence, offset,
   per sequence), whose number depends on `size`, not on the documents.
3. Each piece gets its rank within its length: ranks are counted within salted
   groups, whose totals are added up apart, so a length that a third of all
   pieces share is not one task's work. Salts come from the pieces' numbers in
   the written table, so equal rows spread as well. Rank and length give the slot.

Nulls: a null text is empty and becomes one piece with id 0 only. Repeated rows
are packed each for itself; a row with a null doc_id is packed too. Extra columns
are ignored. An empty table gives no rows. A very long text is encoded alone, with
memory in proportion to its length, and cut into pieces like any other. Ties: pieces
of one length are interchangeable; which of their slots a piece gets is open.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import textkit
from faultline.llm.checkpoints import cut
from faultline.llm.textkit import U

SIZE = 2048
#: Units remembered with their ids by each worker: 32 bytes each at 16-bit ids, 48 at 32-bit ones.
CACHE_WORDS = 1 << 20
#: Ids of a remembered unit; one with more is encoded whenever it comes up.
WIDTH = 8
#: Bytes of text looked at together.
SLICE = 1 << 20
_CACHE: dict[tuple[str, int], Memory] = {}
_MODELS: dict[str, tuple] = {}
#: What a tokenizer file must say for its texts to be cut into units.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Classes of bytes. Units end between letters, digits and marks; GLUE (characters of which nothing is known) stays with its neighbours.
_BLANK, _LETTER, _DIGIT, _MARK, _GLUE = range(5)
_CLASS = np.full(256, _GLUE, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[0x27] = _GLUE  # the apostrophe, see _units
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32
#: Second bytes of the letters from U+00C0 to U+00FF, and what they are in lower case.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False
_SECOND_LOW = np.arange(256, dtype=np.uint8)
_SECOND_LOW[0x80:0x9F] += 32
#: A longer unit is left to the tokenizer.
LONG_UNIT = 64


class Memory:
    """A direct-mapped table from units to ids; a unit replaces the one in its slot, so memory is fixed.

    A slot holds a unit's hash, its length, outer bytes and number of ids, and the ids.
    """

    def __init__(self, words: int, wide: bool) -> None:
        self.kind = np.dtype(np.uint32 if wide else np.uint16)
        slots = 1 << max(1, (words - 1).bit_length())
        self.mask = U(slots - 1)
        self.rows = np.zeros((slots, 2 + WIDTH * self.kind.itemsize // 8), U)


def _model(path: str) -> tuple:
    """(tokenizer, its merges if its texts can be cut into units, else None)"""
    if path not in _MODELS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        said = json.loads(model.to_str())
        before = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
        apart = (
            said["model"]["type"] == "BPE"
            and not any(said["model"].get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
            and (said["normalizer"] or {}).get("normalizers") == _NORMALIZERS
            and [x["type"] for x in before] == ["Split", "ByteLevel"]
            and (before[0]["pattern"], before[0]["behavior"], before[0]["invert"]) == ({"Regex": _SPLIT}, "Removed", True)
            and not (before[1]["add_prefix_space"] or before[1]["use_regex"])
        )
        merges = Merges(said["model"]) if apart else None
        _MODELS[path] = model, merges if apart and min(merges.inner.min(), merges.last.min()) >= 0 else None
    return _MODELS[path]


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer in lower case, units' starts and ends, and which of them hold no glue.

    Units are runs of letters (ASCII and U+00C0 to U+00FF), single digits and runs of
    marks; a run with anything else isn't cut there. An apostrophe ends the letters
    before it; it stands alone before letters unless they begin like a contraction.
    """
    low, kind = _LOW[data], _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_SECOND[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead + 1] = _SECOND_LOW[data[lead + 1]]
    mark = np.flatnonzero(data == 0x27)
    mark = mark[(mark > 0) & (mark < len(data) - 1)]
    after, next_ = low[mark + 1], low[np.minimum(mark + 2, len(data) - 1)]
    short = np.isin(after, [0x64, 0x6D, 0x73, 0x74]) | (np.isin(after, [0x72, 0x76]) & (next_ == 0x65)) | ((after == 0x6C) & (next_ == 0x6C))
    ended = (kind[mark - 1] == _LETTER) | (kind[mark - 1] == _DIGIT)
    kind[mark[ended & (kind[mark + 1] == _LETTER) & ~short]] = _MARK
    cut = np.ones(len(data) + 1, bool)
    a, b = kind[:-1], kind[1:]
    cut[1:-1] = (a == _DIGIT) | ((a != b) & (((a != _GLUE) & (b != _GLUE)) | (a == _BLANK) | (b == _BLANK)))
    cut[1:-1] &= ~((a == _DIGIT) & (b == _GLUE))
    cut[mark[ended]] = True
    cut[offsets] = True
    solid = kind != _BLANK
    starts, ends = np.flatnonzero(cut[:-1] & solid), np.flatnonzero(cut[1:] & solid) + 1
    glue = np.append(0, np.cumsum(kind == _GLUE))
    return low, starts, ends, glue[ends] == glue[starts]


def _scatter(out: np.ndarray, begin: np.ndarray, size: np.ndarray, values: np.ndarray) -> None:
    """Puts values, parted by `size`, at `begin`."""
    out[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(values))] = values


class Merges:
    """Byte-pair merges over many units at once.

    All symbols of all units lie in one array; each step merges the pair of least
    rank (the leftmost one of several) in every unit that still has one, and looks up
    only the pairs that this made. Pairs are found in an open hash table.
    """

    NONE = np.int64(1) << 40

    def __init__(self, said: dict) -> None:
        vocabulary, end = said["vocab"], said.get("end_of_word_suffix") or ""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}
        self.inner = np.array([vocabulary.get(letters[b], -1) for b in range(256)])
        self.last = np.array([vocabulary.get(letters[b] + end, -1) for b in range(256)])
        pairs = [x.split(" ") if isinstance(x, str) else x for x in said["merges"]]
        left, right = (np.array([vocabulary[x[k]] for x in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocabulary[x[0] + x[1]] for x in pairs], np.int64)
        self.bits = max(8, int(len(pairs)).bit_length() + 3)
        self.keys, self.ranks = np.full(1 << self.bits, -1), np.full(1 << self.bits, self.NONE)
        keys = left << 32 | right
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[at[rest]] < 0]
            self.keys[at[free]] = keys[free]
            done = free[self.keys[at[free]] == keys[free]]
            self.ranks[at[done]] = done
            rest = np.setdiff1d(rest, done)
            at[rest] = (at[rest] + (self.keys[at[rest]] >= 0)) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U) * U(0x9E3779B97F4A7C15) >> U(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], self.NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            same = found == keys[open_]
            out[open_[same]] = self.ranks[at[open_[same]]]
            open_ = open_[~same & (found >= 0)]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and how many each has."""
        n = ends - starts
        symbol = self.inner[data[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]]
        symbol[np.cumsum(n) - 1] = self.last[data[ends - 1]]
        rank = np.full(len(symbol), self.NONE)
        rank[:-1] = self.rank(symbol[:-1], symbol[1:])
        rank[np.cumsum(n) - 1] = self.NONE
        size, todo = np.zeros(len(n), np.int64), np.arange(len(n))
        ready: list[tuple[np.ndarray, np.ndarray]] = []
        while len(todo):
            head = np.cumsum(n) - n
            best = np.minimum.reduceat(rank << 20 | np.arange(len(rank)) - np.repeat(head, n), head)
            live = best < self.NONE << 20
            if not live.all():  # units without a pair to merge are ready
                over = ~live
                ready.append((todo[over], symbol[np.repeat(over, n)]))
                size[todo[over]] = n[over]
                stay = np.repeat(live, n)
                symbol, rank, n, todo, best = symbol[stay], rank[stay], n[live], todo[live], best[live]
                head = np.cumsum(n) - n
                if not len(todo):
                    break
            p = head + (best & 0xFFFFF)
            symbol[p] = self.made[best >> 20]
            keep = np.ones(len(symbol), bool)
            keep[p + 1] = False
            tail = p + 2 == head + n
            rank[p] = np.where(tail, self.NONE, self.rank(symbol[p], symbol[np.minimum(p + 2, len(symbol) - 1)]))
            inside = p[p > head]
            rank[inside - 1] = self.rank(symbol[inside - 1], symbol[inside])
            symbol, rank, n = symbol[keep], rank[keep], n - 1
        out, at = np.empty(int(size.sum()), np.uint32), np.cumsum(size) - size
        for units, ids in ready:
            _scatter(out, at[units], size[units], ids)
        return out, size


def _encode_units(data: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, pure: np.ndarray, model, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units, one after the other, and how many each has."""
    plain = pure & (ends - starts <= LONG_UNIT)
    odd, rest = np.flatnonzero(~plain), np.flatnonzero(plain)
    found = [e.ids for e in model.encode_batch_fast([data[a:b].tobytes().decode() for a, b in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)], add_special_tokens=False)]
    ids, own = merges.encode(low, starts[rest], ends[rest]) if len(rest) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    size = np.zeros(len(starts), np.int64)
    size[rest] = own
    size[odd] = [len(x) for x in found]
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint32)
    _scatter(out, at[rest], own, ids)
    _scatter(out, at[odd], size[odd], np.fromiter(chain.from_iterable(found), np.uint32, int(size[odd].sum())))
    return out, size


def encode_slice(data: np.ndarray, offsets: np.ndarray, path: str, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows of a buffer, one after the other, and len + 1 offsets of the rows' ids.

    Units that the tokenizer parts anyway are hashed and looked up in the worker's
    memory, where 64 bits, the length and the outer bytes must agree, and encoded where
    they are not known. Rows with "<|" may hold special tokens and are encoded whole,
    as all rows are with a tokenizer of another make. `end`: an id after each row.
    """
    model, merges = _model(path)
    key = (path, CACHE_WORDS)
    if key not in _CACHE:
        _CACHE[key] = Memory(CACHE_WORDS, model.get_vocab_size() > 1 << 16)
    memory = _CACHE[key]
    rows = len(offsets) - 1
    whole = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) else np.zeros(0, int)
    whole = np.unique(np.searchsorted(offsets, whole, "right") - 1) if merges else np.flatnonzero(np.diff(offsets))
    low, starts, ends, pure = _units(data, offsets) if merges and len(data) else (data, *np.zeros((2, 0), int), np.zeros(0, bool))
    owner = np.repeat(np.arange(rows), np.diff(np.searchsorted(starts, offsets)))
    if len(whole) and len(owner):
        cut_up = np.ones(rows, bool)
        cut_up[whole] = False
        use = cut_up[owner]
        starts, ends, owner, pure = starts[use], ends[use], owner[use], pure[use]
    first = textkit.hashes(low, starts, ends, "space")
    about = (ends - starts).astype(U) << U(24) | low[starts].astype(U) << U(16) | low[ends - 1].astype(U) << U(8)
    slot = (first & memory.mask).astype(np.int64)
    held = np.take(memory.rows, slot, axis=0, mode="clip")
    size = (held[:, 1] & U(255)).astype(np.int64)
    hit = (held[:, 0] == first) & (held[:, 1] - size.astype(U) == about) & (size > 0)
    miss = np.flatnonzero(~hit)
    _, lead, again = np.unique(first[miss] ^ about[miss], return_index=True, return_inverse=True)
    lead = miss[lead]
    new_ids, new_size = _encode_units(data, low, starts[lead], ends[lead], pure[lead], model, merges)
    new_at = np.cumsum(new_size) - new_size
    size[miss] = new_size[again]
    texts = [np.array(model.encode(data[offsets[r] : offsets[r + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for r in whole.tolist()]
    per_row = np.bincount(owner, size, rows).astype(np.int64) + (end is not None)
    per_row[whole] += np.array([len(t) for t in texts], np.int64)
    row_at = np.append(0, np.cumsum(per_row))
    out = np.full(int(row_at[-1]), 0 if end is None else end, np.uint32)
    begin = np.cumsum(size) - size
    if len(owner):
        head = np.searchsorted(owner, np.arange(rows))  # the first unit of each row
        begin += (row_at[:-1] - begin[np.minimum(head, len(owner) - 1)])[owner]
    ids = held[:, 2:].copy().view(memory.kind)
    for k in range(WIDTH):
        some = np.flatnonzero(hit & (size > k))
        out[begin[some] + k] = ids[some, k]
    take = np.repeat(new_at[again] - (np.cumsum(size[miss]) - size[miss]), size[miss]) + np.arange(int(size[miss].sum()))
    _scatter(out, begin[miss], size[miss], new_ids[take])
    for r, found in zip(whole.tolist(), texts, strict=True):
        out[row_at[r] : row_at[r] + len(found)] = found
    fits = np.flatnonzero((new_size > 0) & (new_size <= WIDTH))
    if len(fits):
        unit, n, at = lead[fits], new_size[fits], new_at[fits]
        grid = np.zeros((len(fits), WIDTH), memory.kind)
        for k in range(WIDTH):
            some = np.flatnonzero(n > k)
            grid[some, k] = new_ids[at[some] + k]
        memory.rows[slot[unit]] = np.column_stack([first[unit], about[unit] | n.astype(U), grid.view(U)])
    return out, row_at


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text."""
    data, offsets = textkit.buffers(pa.array(texts, pa.large_string()))
    out = []
    for i, j in textkit.slices(offsets, SLICE):
        ids, at = encode_slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], path)
        out += [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


@textkit.lean
def _tokenise(batches, path: str, size: int, keep: bool):
    nth = 0
    for batch in batches:
        data, offsets = textkit.buffers(batch.column("text"))
        doc_ids = batch.column("doc_id")
        for i, j in textkit.slices(offsets, SLICE):
            ids, at = encode_slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], path, end=0)
            count = -(-np.diff(at) // size)
            row = np.repeat(np.arange(j - i), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * size
            length = np.minimum(at[1:][row] - at[:-1][row] - start, size)
            begin = at[:-1][row] + start
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            bodies = pa.array([bytes(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)] if keep else [None] * len(row), pa.binary())
            numbers = pa.array(np.arange(nth, nth + len(row)))
            nth += len(row)
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(row + i)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), bodies, numbers],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "nth"],
            )


def pieces(docs: DataFrame, path: str, size: int = SIZE, ids: bool = False) -> DataFrame:
    """A row per piece; nth: the piece's number in its task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _tokenise(batches, path, size, ids), _PIECES + ", nth long")


def plan(histogram: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Best-fit decreasing over counts.

    Rows of (length, first rank, count, first sequence, offset, per sequence); item j
    of a run goes to sequence first + j // per at offset + (j % per) * length.
    """
    runs: list[tuple[int, ...]] = []
    rooms: list[int] = []  # fill levels with free room, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, sequences)]
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                room, first = size, opened
                n = -(-left // (size // length))
                opened += n
            per = room // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, full * per, first, size - room, per))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < n:
                runs.append((length, rank, left, first + full, size - room, per))
                put(room - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            put(room, first + full, n - full)
    return np.array(runs, np.int64).reshape(-1, 6)


@textkit.lean
def _place(batches, runs: np.ndarray):
    order = np.lexsort((runs[:, 1], runs[:, 0])) if len(runs) else []
    runs = runs[order] if len(runs) else runs
    key = runs[:, 0] << 44 | runs[:, 1]
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        run = runs[np.searchsorted(key, length << 44 | rank, "right") - 1]
        j = rank - run[:, 1]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")), pa.array(run[:, 3] + j // run[:, 5]), pa.array(run[:, 4] + j % run[:, 5] * length)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, path: str, size: int = SIZE, ids: bool = False, per_salt: int = 200_000) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, ids (null unless `ids`), sequence_id, offset."""
    made = cut(pieces(docs, path, size, ids))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs = plan(histogram, size)
    salts = max(16, -(-sum(histogram.values()) // per_salt))
    salted = made.withColumn("salt", F.pmod("nth", F.lit(salts)))  # numbers of the written table, so equal rows spread too
    totals = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("r", F.row_number().over(within) - 1).join(base, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
    ready = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("r")).alias("rank"))
    return ready.mapInArrow(lambda batches: _place(batches, runs), _PIECES + ", sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, tokenizer_path()).drop("ids")

