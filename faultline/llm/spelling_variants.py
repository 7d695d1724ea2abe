"""Spelling variants: words at distance one, grouped under their most frequent form.

The vocabulary is dealt to tasks in ranges of the sorted words, so each task holds a
connected piece of the trie: its size is set by `range_words`, whatever prefix is
frequent. Inside a piece, node pairs at distance one (active nodes) start where two
words part at a node and go down the trie together, letter by letter, as long as both
have the next one; pairs that end at words are the answer. The nodes on a piece's edges,
that is the prefixes of its first and last word, may have children in other pieces too.
An active node that starts there has spent its one edit, so the rest must be equal:
each word is sent on, for each such node, under what is left of it without the letter
after the node, and under itself. Words that meet under one such rest are near. A group
holds at most the alphabet's size of words for each position, so no group grows with
the data, and each near pair is found exactly once. Words of more than LONGEST letters stay out of the
trie and meet under hashes of all their rests, one for each letter.

Words: maximal runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lower-cased, of whole texts. An
injected misspelling (see `misspell`) may delete a letter of a run. Nulls: a null text
has no words, a null doc_id counts as an empty string. Repeated rows count again, texts
of any length are taken whole, other columns of docs are not read, an empty table gives
an empty one. Ties between forms of equal count go to the least word in code-point order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.checkpoints import cut

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one trie piece.
RANGE_WORDS = 50_000
#: Longer words don't enter the trie: a piece's memory is RANGE_WORDS * LONGEST letters.
LONGEST = 64
#: Node pairs expanded at a time; bounds a task's memory.
PAIRS = 1 << 20


def misspell(doc_id: Column, word: Column, every: int) -> Column:
    """The word without its code point h % length if `every` divides h, the crc32 of "<doc_id>:<word>"."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, every: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """word, n: the words of at least min_length code points that occur min_count times or more."""
    runs = docs.select(F.col("doc_id").alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= min_length).select("d", F.translate("run", UPPER, LOWER).alias("run"))
    found = words.select(misspell(F.col("d"), F.col("run"), every).alias("word")).where(F.length("word") >= min_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Piece:
    """A sorted range of words as a trie in arrays: nodes are numbered within each depth, in word order."""

    def __init__(self, words: list[str]) -> None:
        raw = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in raw])
        depth = int(self.size.max())
        self.letters = np.frombuffer(b"".join(w.ljust(depth, b"\0") for w in raw), np.uint8).reshape(len(raw), depth)
        differs = np.cumsum(self.letters[1:] != self.letters[:-1], axis=1) > 0
        self.first, self.word, self.parent_key = [np.zeros(1, np.int64)], [np.full(1, -1)], [np.zeros(1, np.int64)]
        of = np.zeros(len(raw), np.int64)  # node of each word at the depth before
        self.children = []
        for d in range(depth):
            alive = self.size > d
            new = alive.copy()
            new[1:] &= differs[:, d] | (self.size[:-1] <= d)
            first = np.flatnonzero(new)
            node = np.cumsum(new) - 1
            key = of[first] * 256 + self.letters[first, d]
            ends = np.full(len(first), -1)
            whole = np.flatnonzero(self.size == d + 1)
            ends[node[whole]] = whole
            self.children.append(np.searchsorted(key, np.arange(len(self.first[-1]) + 1) * 256))
            self.first.append(first)
            self.word.append(ends)
            self.parent_key.append(key)
            of = node
        self.children.append(np.zeros(len(self.first[-1]) + 1, np.int64))
        self.edges = self._edges(words[0], words[-1])

    def _edges(self, first: str, last: str) -> np.ndarray:
        """For each word, how many letters it shares with the first or the last one: at these depths and above, its node is on the piece's edge."""
        depth = self.letters.shape[1]
        both = [np.frombuffer(w.encode("latin-1").ljust(depth, b"\0"), np.uint8) for w in (first, last)]
        shared = [np.cumprod(self.letters == w, axis=1) for w in both]
        return np.minimum(np.maximum(shared[0].sum(1), shared[1].sum(1)), self.size)

    def is_edge(self, depth: int) -> np.ndarray:
        """Which nodes of a depth are prefixes of the first or last word."""
        return self.edges[self.first[depth]] >= depth

    def _starts(self, depth: int):
        """Active pairs that spend their edit below the inner nodes of a depth: (depth of u, depth of v, u, v)."""
        inner = np.flatnonzero(~self.is_edge(depth)) if depth else np.zeros(0, np.int64)
        lo, hi = self.children[depth][inner], self.children[depth][inner + 1]
        u, owner = _spread(lo, hi)
        if not len(u):
            return
        node = inner[owner]
        # one letter more: the child against its own parent, unless it repeats the letter before
        letter, before = self.parent_key[depth + 1][u] % 256, self.parent_key[depth][node] % 256
        more = letter != before
        yield depth + 1, depth, u[more], node[more]
        # another letter: siblings
        ends = hi[owner]
        for i in range(0, len(u), PAIRS // 256):
            v, at = _spread(u[i : i + PAIRS // 256] + 1, ends[i : i + PAIRS // 256])
            yield depth + 1, depth + 1, u[i : i + PAIRS // 256][at], v

    def pairs(self):
        """(word, word) index pairs at distance one that spend their edit at an inner node, in chunks."""
        for depth in range(len(self.first) - 1):
            for start in self._starts(depth):
                todo = [start]
                while todo:
                    du, dv, u, v = todo.pop()
                    if not len(u):
                        continue
                    if len(u) > PAIRS:
                        half = len(u) // 2
                        todo += [(du, dv, u[:half], v[:half]), (du, dv, u[half:], v[half:])]
                        continue
                    a, b = self.word[du][u], self.word[dv][v]
                    if len(met := np.flatnonzero((a >= 0) & (b >= 0))):
                        yield a[met], b[met]
                    if du + 1 < len(self.first) and dv + 1 < len(self.first):
                        child, owner = _spread(self.children[du][u], self.children[du][u + 1])
                        wanted = v[owner] * 256 + self.parent_key[du + 1][child] % 256
                        keys = self.parent_key[dv + 1]
                        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                        both = keys[at] == wanted
                        todo.append((du + 1, dv + 1, child[both], at[both]))


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi, and which range each is of."""
    count = np.maximum(hi - lo, 0)
    owner = np.repeat(np.arange(len(lo)), count)
    return np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + lo[owner], owner


def _near(piece: Piece, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, how many inner near words it has and the best of them (-1: none)."""
    count, best = np.zeros(len(n), np.int64), np.full(len(n), -1)
    for a, b in piece.pairs():
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        count += np.bincount(a, minlength=len(n))
        order = np.lexsort((b, -n[b], a))
        a, b = a[order], b[order]
        first = np.ones(len(a), bool)
        first[1:] = a[1:] != a[:-1]
        a, b = a[first], b[first]
        old = best[a]
        better = (old < 0) | (n[b] > n[old]) | ((n[b] == n[old]) & (b < old))
        best[a[better]] = b[better]
    return count, best


SCHEMA = "kind int, rest string, at int, sole boolean, word string, n long, n_near long, form string, form_n long"


def _join_piece(batches):
    """A task's whole range: what it finds inside (kind 0), and its words under their rests at the edge nodes (kind 1)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by("word")
    words, n = table["word"].to_pylist(), table["n"].to_numpy()
    piece = Piece(words)
    count, best = _near(piece, n)
    for i in range(0, len(words), 10_000):
        some = range(i, min(i + 10_000, len(words)))
        rows: list[tuple] = [(0, None, None, None, words[k], int(n[k]), int(count[k]), words[best[k]] if best[k] >= 0 else None, int(n[best[k]]) if best[k] >= 0 else None) for k in some]
        for k in some:
            w = words[k]
            rows.append((1, w, -1, True, w, int(n[k]), None, None, None))
            for at in range(min(int(piece.edges[k]) + 1, len(w))):
                rows.append((1, w[:at] + w[at + 1 :], at, at == 0 or w[at - 1] != w[at], w, int(n[k]), None, None, None))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def _meet(rests: DataFrame) -> DataFrame:
    """(word, n, form, form_n) of every two words that meet under a rest, either way round.

    Both lack another letter at the same place: groups of at most as many words as
    there are letters. Or one is the rest itself and the other lacks a letter of it,
    the first of a run of equal ones, so that no two places give one pair.
    """
    held = rests.where("at >= 0").groupBy("rest", "at").agg(F.collect_list(F.struct("word", "n")).alias("held")).where("size(held) > 1")
    other = held.select("held", F.explode("held").alias("x")).select("x.*", F.explode("held").alias("y")).where("word <> y.word")
    longer = rests.where("sole and at >= 0").select("rest", F.struct("word", "n").alias("x"))
    whole = rests.where("at < 0").select("rest", F.struct("word", "n").alias("y"))
    more = longer.join(whole, "rest").select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("p")).select("p.x.*", "p.y")
    return other.unionByName(more).select("word", "n", F.col("y.word").alias("form"), F.col("y.n").alias("form_n"))


def _as_best(form: str, form_n: str) -> Column:
    return F.when(F.col(form).isNotNull(), F.struct((-F.col(form_n)).alias("minus"), F.col(form).alias("form")))


_MODULUS = (1 << 61) - 1
_BASES = (0x1D2F5A7C93B1E46F % _MODULUS, 0x0B9E3C68D5471A2D % _MODULUS)


def _rest_hashes(word: str, each: bool) -> list[tuple[str, int, bool]]:
    """(hash of the rest, position, whether the letter differs from the one before) of the word itself and, if `each`, without each letter, in linear time."""
    raw, forms = word.encode("latin-1"), []
    for base in _BASES:
        power, after = 1, 0
        tails = [(0, 1)]  # of each suffix: its hash and base ** its length
        for b in reversed(raw):
            after = (after + b * power) % _MODULUS
            power = power * base % _MODULUS
            tails.append((after, power))
        tails.reverse()
        head, out = 0, [tails[0][0]]
        if each:
            for i, b in enumerate(raw):
                after, power = tails[i + 1]
                out.append((head * power + after) % _MODULUS)
                head = (head * base + b) % _MODULUS
        forms.append(out)
    keys = [f"{x:x}.{y:x}" for x, y in zip(*forms, strict=True)]
    return [(keys[0], -1, True)] + [(k, i, i == 0 or raw[i] != raw[i - 1]) for i, k in enumerate(keys[1:])]


def _long_rests(batches):
    """Rests of words that are too long for the trie; each names its word by a digest."""
    for batch in batches:
        for word, digest in zip(batch.column("word").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            rests = _rest_hashes(word, len(word) > LONGEST)
            for i in range(0, len(rests), 100_000):
                keys, at, sole = zip(*rests[i : i + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(at, pa.int32()), pa.array(sole, pa.bool_()), pa.array([digest] * len(keys), pa.string())], names=["rest", "at", "sole", "word"])


def _long_near(words: DataFrame) -> DataFrame:
    """_meet for pairs with a word of more than LONGEST letters, by 122-bit hashes of their rests instead of the rests themselves."""
    known = cut(words.where(F.length("word") >= LONGEST).withColumn("digest", F.md5(F.col("word").cast("binary"))))
    rests = known.select("word", "digest").mapInArrow(_long_rests, "rest string, at int, sole boolean, word string").withColumn("n", F.lit(0).cast("long"))
    pairs = _meet(rests).select(F.col("word").alias("digest"), F.col("form").alias("other"))
    others = known.select(F.col("digest").alias("other"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    return pairs.join(known, "digest").join(others, "other").select("word", "n", "form", "form_n")


def near_words(words: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """word, n, n_near (other words at distance one), form and form_n (the most frequent of them, else null), for distinct words of (word, n)."""
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    short = words.where(F.length("word") <= LONGEST)
    n_words, n_short = words.agg(F.count("*"), F.count(F.when(F.length("word") <= LONGEST, 1))).first()
    pieces = max(1, math.ceil(n_short / range_words))
    found = cut(short.repartitionByRange(pieces, "word").mapInArrow(_join_piece, SCHEMA))
    inner = found.where("kind = 0").select("word", "n", "n_near", "form", "form_n")
    outer = _meet(found.where("kind = 1").select("rest", "at", "sole", "word", "n"))
    if n_words > n_short:
        inner = inner.unionByName(words.where(F.length("word") > LONGEST).select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n")))
        outer = outer.unionByName(_long_near(words))
    both = inner.unionByName(outer.withColumn("n_near", F.lit(1).cast("long"))).withColumn("best", _as_best("form", "form_n"))
    both = both.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return both.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def group_variants(words: DataFrame, factor: int = 2, range_words: int = RANGE_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words of (word, n).

    form is the near word of largest n if that is factor * n or more. Forms at least
    double the count, so the longest way to a root has log2(largest n) steps; it is
    halved in each round of joins. factor: 2 or more.
    """
    if factor < 2:
        raise ValueError("factor: 2 or more, so that the way to a root stays short")
    near = near_words(words, range_words)
    has = F.col("form_n") >= factor * F.col("n")
    now = cut(near.select("word", "n", "n_near", *[F.when(has, F.col(c)).alias(c) for c in ("form", "form_n")]))
    links = now.where("form is not null").select("word", F.col("form").alias("root"))
    largest = now.agg(F.max("n")).first()[0] or 1
    rounds = math.ceil(math.log2(max(math.log2(largest), 1))) + 1 if not links.isEmpty() else 0
    for _ in range(rounds):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = cut(links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return now.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return group_variants(vocabulary(docs))


#: crc32 by its table of 256 steps; near words meet under their rests; roots by recursion.
ORACLE = r"""
with recursive bits(b, c, k) as (select range, range, 0 from range(256) union all select b, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, k + 1 from bits where k < 8),
tab as materialized (select list(c order by b) as t from bits where k = 8),
runs as (select coalesce(doc_id::varchar, '') as d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
each as materialized (select d, run, count(*) as n from runs where length(run) >= 5 group by d, run),
coded as (select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(encode(d || ':' || run))), lambda i: ('0x' || substr(hex(encode(d || ':' || run)), 2 * i + 1, 2))::bigint)),
  lambda acc, b: xor(acc // 256, t[xor(acc % 256, b) + 1]))) as h from each, tab),
made as (select n, case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from coded),
words as materialized (select word, sum(n)::bigint as n from made where length(word) >= 5 group by word having sum(n) >= 3),
rests as materialized (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (select a.word, b.word as other, b.n as other_n from rests a join rests b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select r.word, w.word, w.n from rests r join words w on w.word = rest union select w.word, r.word, r.n from rests r join words w on w.word = rest),
best as materialized (select words.word, n, count(other) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from words left join pairs on pairs.word = words.word group by words.word, n),
forms as materialized (select word, n, n_near, case when other_n >= 2 * n then other end as form, case when other_n >= 2 * n then other_n end as form_n from best),
way(word, stop) as (select word, form from forms where form is not null union all select way.word, forms.form from way join forms on forms.word = stop where forms.form is not null),
ends as (select way.word, stop from way join forms on forms.word = stop where forms.form is null)
select forms.word, form, coalesce(stop, forms.word) as root, n, n_near, form_n from forms left join ends on ends.word = forms.word
"""
