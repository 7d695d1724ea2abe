"""Codes for vectors: product quantisation, fitted by Lloyd's rounds over heaps of bounds.

Vectors are cut into equal parts; each part position has a codebook of its own. Rows
are dealt to blocks of BLOCK vectors, and a block keeps for each entry of each codebook
a heap of the parts assigned to it. A part's key is its lower bound (distance to the
second nearest entry) minus its upper bound (distance to its own), plus the drift summed
up by the entry until then: how far the entry moved, and the farthest that any other
moved. While that sum stays below the key, no other entry can have become nearer. So a
round walks down each heap from its root only as far as keys are violated, compares
those parts with the whole codebook in integers, and files them anew; all others keep
their entry unseen. A round's sums are the last round's plus what the parts that changed
entries take along: one row per entry and task is added up, and only the codebooks, whose
size is fixed, reach the driver.

Components are floor(scale * x). Bounds are floating point, widened by MARGIN and used
to skip only; every assignment made is exact, ties going to the lowest entry.

Defined cases: rows are dropped if the vector is null, empty, has a null or non-finite
component or one beyond LARGEST after scaling (whose squares 64 bits don't hold), isn't
cut evenly, or has another length than the kept vector of the least id. Null ids are
coded but never seed a codebook (if there are no others, its one entry is zero); of repeated ids each row counts, in the order of their
components. Fewer rows than entries give fewer entries. Without rows the result is
empty. Other columns are not read. Vectors are held BLOCK at a time, whatever their number.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.checkpoints import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block: one row of the written state.
BLOCK = 512
LARGEST = 1 << 24
#: Relative width by which bounds are made safe against rounding.
MARGIN = 1e-9

BLOCKS = "ids array<long>, labels array<string>, parts binary, codes binary, keys binary, rows binary, ends binary"
SUMS = "part int, entry int, count long, total array<long>"


class Codebooks:
    """All positions' entries: an array of (part, entry, component), and how far entries drifted since the start."""

    def __init__(self, entries: np.ndarray, drift: np.ndarray | None = None) -> None:
        self.entries = entries
        self.drift = np.zeros(entries.shape[:2]) if drift is None else drift

    def moved(self, entries: np.ndarray) -> Codebooks:
        """The codebooks after an update; an entry's drift grows by its own way and the longest of the others."""
        way = np.sqrt(((entries - self.entries) ** 2).sum(2).astype(float)) * (1 + MARGIN)
        others = np.zeros_like(way)
        if way.shape[1] > 1:
            two = np.sort(way, axis=1)[:, -2:]
            others = np.where(np.arange(way.shape[1]) == way.argmax(1)[:, None], two[:, :1], two[:, 1:])
        return Codebooks(entries, (self.drift + way + others) * (1 + MARGIN))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and the safe slack to the next one, by exact squared distances."""
    distance = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        distance += (x[:, k, None] - entries[None, :, k]) ** 2
    code = distance.argmin(1)
    near = distance[np.arange(len(x)), code]
    if len(entries) > 1:
        distance[np.arange(len(x)), code] = np.iinfo(np.int64).max
        lower = np.sqrt(distance.min(1).astype(float))
    else:
        lower = np.full(len(x), np.inf)
    return code, lower * (1 - MARGIN) - np.sqrt(near.astype(float)) * (1 + MARGIN)


class Block:
    """The vectors of one row of the state. Heaps of one part position lie behind each other, ends saying where each stops."""

    def __init__(self, x: np.ndarray, n_entries: int, codes=None, keys=None, rows=None, ends=None) -> None:
        self.x, n = x, x.shape[1]
        self.codes = np.zeros((len(x), n), np.uint8) if codes is None else codes
        self.keys = np.zeros((len(x), n)) if keys is None else keys
        self.rows = np.zeros((len(x), n), np.int32) if rows is None else rows
        self.ends = np.zeros((len(x), n_entries), np.int32) if ends is None else ends

    @classmethod
    def load(cls, row: dict, width: int, n_entries: int) -> Block:
        n = len(row["ids"])
        held = [np.frombuffer(row[c], t).copy() for c, t in (("parts", np.int32), ("codes", np.uint8), ("keys", np.float64), ("rows", np.int32), ("ends", np.int32))]
        parts = held[0].size // (n * width)
        return cls(held[0].reshape(parts, n, width).astype(np.int64), n_entries, held[1].reshape(parts, n), held[2].reshape(parts, n), held[3].reshape(parts, n), held[4].reshape(parts, n_entries))

    def columns(self) -> dict:
        return {"parts": self.x.astype(np.int32).tobytes(), "codes": self.codes.tobytes(), "keys": self.keys.tobytes(), "rows": self.rows.tobytes(), "ends": self.ends.tobytes()}

    def fill(self, books: Codebooks) -> None:
        """First round: every part is compared with every entry."""
        for p, x in enumerate(self.x):
            code, slack = _scan(x, books.entries[p])
            self._file(p, np.arange(len(x)), code, slack + books.drift[p][code])

    def _file(self, p: int, rows: np.ndarray, code: np.ndarray, keys: np.ndarray) -> None:
        """Heaps of a position from all of its rows: ascending keys within each entry are in heap order."""
        order = np.lexsort((keys, code))
        self.codes[p][rows] = code
        self.rows[p], self.keys[p] = rows[order], keys[order]
        self.ends[p] = np.cumsum(np.bincount(code, minlength=self.ends.shape[1]))

    def pop(self, p: int, drift: np.ndarray) -> np.ndarray:
        """Places of the violated keys: from the roots down, children are seen only under a violated parent."""
        ends = self.ends[p]
        starts = np.concatenate([[0], ends[:-1]])
        entry = np.flatnonzero(starts < ends)
        node = np.zeros(len(entry), np.int64)
        out = []
        while len(entry):
            bad = self.keys[p][starts[entry] + node] <= drift[entry]
            entry, node = entry[bad], node[bad]
            out.append(starts[entry] + node)
            entry, node = np.concatenate([entry, entry]), np.concatenate([2 * node + 1, 2 * node + 2])
            inside = starts[entry] + node < ends[entry]
            entry, node = entry[inside], node[inside]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def repair(self, books: Codebooks):
        """Rescans violated parts; yields (part, rows, old entries, new entries) of those that change."""
        for p in range(len(self.x)):
            places = self.pop(p, books.drift[p])
            if not len(places):
                continue
            rows = self.rows[p][places]
            code, slack = _scan(self.x[p][rows], books.entries[p])
            old = self.codes[p][rows].astype(np.int64)
            self.keys[p][places] = slack + books.drift[p][code]
            self.codes[p][rows] = code
            self._file(p, self.rows[p].copy(), self.codes[p][self.rows[p]].astype(np.int64), self.keys[p].copy())
            changed = code != old
            if changed.any():
                yield p, rows[changed], old[changed], code[changed]


class Sums:
    """Counts and component sums by part and entry."""

    def __init__(self, parts: int, entries: int, width: int) -> None:
        self.count = np.zeros((parts, entries), np.int64)
        self.total = np.zeros((parts, entries, width), np.int64)

    def add(self, p: int, code: np.ndarray, x: np.ndarray, sign: int = 1) -> None:
        self.count[p] += sign * np.bincount(code, minlength=self.count.shape[1])
        np.add.at(self.total[p], code, sign * x)

    def batch(self) -> pa.RecordBatch:
        part, entry = np.nonzero(self.count | self.total.any(2))
        return pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(self.count[part, entry]), pa.array(self.total[part, entry].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "count", "total"],
        )


def _integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _usable(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """id, label and the integer components of the rows that have some; one length."""
    x = F.col("embedding")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale <= LARGEST)), F.lit(False))
    rows = vectors.where(fine & (F.size(x) > 0) & (F.size(x) % parts == 0))
    return rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), _integers(x, scale).alias("x"))


def _blocks(batches, books: Codebooks):
    """First round: rows to blocks, each with its heaps."""
    parts, n_entries, width = books.entries.shape
    for batch in batches:
        ids, labels, x = batch.column("id"), batch.column("label"), batch.column("x")
        for i in range(0, len(ids), BLOCK):
            some = x.slice(i, BLOCK)
            block = Block(np.ascontiguousarray(np.asarray(some.flatten()).reshape(len(some), parts, width).transpose(1, 0, 2)), n_entries)
            block.fill(books)
            yield _state(ids.slice(i, BLOCK).to_pylist(), labels.slice(i, BLOCK).to_pylist(), block)


def _state(ids: list, labels: list, block: Block) -> pa.RecordBatch:
    row = {"ids": ids, "labels": labels, **block.columns()}
    kinds = {"ids": pa.list_(pa.int64()), "labels": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row))


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _first_sums(batches, books: Codebooks):
    sums = Sums(*books.entries.shape)
    for row in _rows(batches):
        block = Block.load(row, books.entries.shape[2], books.entries.shape[1])
        for p in range(len(block.x)):
            sums.add(p, block.codes[p].astype(np.int64), block.x[p])
    yield sums.batch()


def _repaired(batches, books: Codebooks):
    for row in _rows(batches):
        block = Block.load(row, books.entries.shape[2], books.entries.shape[1])
        for _ in block.repair(books):
            pass
        yield _state(row["ids"], row["labels"], block)


def _changes(batches, books: Codebooks):
    """What a round's changed parts take from their old entries and bring to the new ones."""
    sums = Sums(*books.entries.shape)
    for row in _rows(batches):
        block = Block.load(row, books.entries.shape[2], books.entries.shape[1])
        for p, rows, old, new in block.repair(books):
            sums.add(p, old, block.x[p][rows], -1)
            sums.add(p, new, block.x[p][rows])
    yield sums.batch()


def _coded(batches, books: Codebooks):
    """The last assignment: id, label, code and error of each vector."""
    for row in _rows(batches):
        block = Block.load(row, books.entries.shape[2], books.entries.shape[1])
        for _ in block.repair(books):
            pass
        error = np.zeros(len(row["ids"]), np.int64)
        for p, x in enumerate(block.x):
            error += ((x - books.entries[p][block.codes[p]]) ** 2).sum(1)
        text = [bytes(c).hex() for c in block.codes.T]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(text), pa.array(error)],
            names=["vec_id", "label", "code", "error"],
        )


def _totals(rows: DataFrame, shape: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sums of all tasks: at most one row for each entry of each codebook."""
    width = shape[2]
    found = rows.groupBy("part", "entry").agg(F.sum("count").alias("count"), *[F.sum(F.col("total")[k]).alias(f"t{k}") for k in range(width)]).collect()
    count, total = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
    for r in found:
        count[r.part, r.entry] = r["count"]
        total[r.part, r.entry] = [r[f"t{k}"] for k in range(width)]
    return count, total


def fit_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of every usable vector, and the codebooks, after `rounds` of Lloyd's rounds.

    A codebook starts as the parts of the least ids. rounds: 1 or more; entries: up to 256.
    """
    if not (1 <= entries <= 256 and rounds >= 1):
        raise ValueError("entries: 1 to 256, rounds: 1 or more")
    spark = vectors.sparkSession
    rows = _usable(vectors, parts, scale)
    seeds = rows.where("id is not null").orderBy("id", "x")
    first = seeds.select(F.size("x").alias("n")).limit(1).collect() or rows.select(F.size("x").alias("n")).limit(1).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long"), Codebooks(np.zeros((parts, 0, 0), np.int64))
    rows, seeds = rows.where(F.size("x") == first[0].n), seeds.where(F.size("x") == first[0].n)
    width = first[0].n // parts
    start = [r.x for r in seeds.select("x").limit(entries).collect()] or [[0] * first[0].n]
    books = Codebooks(np.array(start, np.int64).reshape(len(start), parts, width).transpose(1, 0, 2).copy())
    shape = books.entries.shape

    begun = books
    state = cut(rows.mapInArrow(lambda batches: _blocks(batches, begun), BLOCKS))
    count, total = _totals(state.mapInArrow(lambda batches: _first_sums(batches, begun), SUMS), shape)
    for k in range(rounds):
        if k:
            changes = state.mapInArrow(lambda batches, now=books: _changes(batches, now), SUMS)
            more_count, more_total = _totals(changes, shape)
            count, total = count + more_count, total + more_total
            if k < rounds - 1:
                state = cut(state.mapInArrow(lambda batches, now=books: _repaired(batches, now), BLOCKS))
        used = count > 0
        books = books.moved(np.where(used[:, :, None], total // np.maximum(count, 1)[:, :, None], books.entries))
    last = books
    return state.mapInArrow(lambda batches: _coded(batches, last), "vec_id long, label string, code string, error long"), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    found, books = fit_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    found = cut(found)
    totals = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


_ASSIGN = """
d{k} as (select vec_id, e.p, e.e, sum((x.x - e.x) ** 2)::bigint as dist from x join book{k} e on e.p = x.p and e.j = x.j group by vec_id, e.p, e.e),
c{k} as materialized (select vec_id, p, arg_min(e, (dist, e)) as e, min(dist) as dist from d{k} group by vec_id, p),"""
_UPDATE = """
m{k} as (select c.p, c.e, x.j, floor(sum(x.x) / count(*))::bigint as x from c{k} c join x on x.vec_id = c.vec_id and x.p = c.p group by c.p, c.e, x.j),
book{n} as materialized (select b.p, b.e, b.j, coalesce(m.x, b.x) as x from book{k} b left join m{k} m on m.p = b.p and m.e = b.e and m.j = b.j),"""
#: For distinct vec_ids.
ORACLE = (
    """
with kept as materialized (select vec_id, label, embedding, len(embedding) // 16 as w from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
x as materialized (select vec_id, (i - 1) // w as p, (i - 1) % w as j, floor(256 * embedding[i]::double)::bigint as x from (select *, unnest(range(1, len(embedding) + 1)) as i from kept)),
book0 as materialized (select p, e, j, x from x join (select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit 64) s on s.vec_id = x.vec_id),"""
    + "".join(_ASSIGN.format(k=k) + _UPDATE.format(k=k, n=k + 1) for k in range(ROUNDS))
    + _ASSIGN.format(k=ROUNDS)
    + f"""
coded as (select vec_id, string_agg(printf('%02x', e), '' order by p) as code, sum(dist)::bigint as error from c{ROUNDS} group by vec_id),
sha as (select sha256(string_agg(x::varchar, ',' order by p, e, j)) as codebooks_sha256 from book{ROUNDS})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded join kept using (vec_id), sha
"""
)
