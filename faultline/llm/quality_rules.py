"""Quality rules as a short-circuit cascade of built-in expressions.

A measure is a chain of columns over the text; a rule rejects a document by one
measure. On a sample of about SAMPLE_ROWS rows, taken alike from all files, each rule's
selectivity is the share that it rejects, and its cost what its measure touches there:
characters and words, weighed by COSTS. Times of the sample's own run are not used, as
they are noise. Rules then run in order of rejections per cost, each only on documents
that no earlier rule rejected: the later rules' columns are guarded by the verdict so
far, so their work is skipped.
The order never changes which documents go, only what it costs to find out. The query
returns four measures of every row, so only the work of the other rules is skipped there.

Words are runs of anything but ASCII white space. Repeats are windows of five
words that occur twice in one text, found by sorting 64-bit hashes with their
places. Nulls: a null text has no words. Rows are judged one by one; repeated
rows and null doc_ids need nothing else. Other columns stay as they are, whatever
their names; only one called `rejected_by` gives way to cascade()'s. A very long text is a row like any other;
its words and windows are arrays of that row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.columns import set_aside

SAMPLE_ROWS = 500
Step = tuple[str, Callable[[], Column]]


def _c(name: str) -> Column:
    return F.col(f"q__{name}")


def _repeat_steps() -> list[Step]:
    return [
        ("word_hash", lambda: F.transform(_c("words"), lambda w: F.xxhash64(w))),
        (
            "windows",
            lambda: F.when(
                F.size(_c("word_hash")) >= 5,
                F.sort_array(F.transform(F.sequence(F.lit(0), F.size(_c("word_hash")) - 5), lambda i: F.struct(F.xxhash64(*[F.get(_c("word_hash"), i + k) for k in range(5)]).alias("h"), i.alias("i")))),
            ),
        ),
        (
            "repeat_at",
            lambda: F.sort_array(
                F.transform(
                    F.filter(_c("windows"), lambda x, i: (F.get(_c("windows"), i - 1)["h"] == x["h"]) | (F.get(_c("windows"), i + 1)["h"] == x["h"])),
                    lambda x: x["i"],
                )
            ),
        ),
        (
            "n_repeat_words",
            lambda: F.coalesce(F.aggregate(F.transform(_c("repeat_at"), lambda p, i: F.when(i == F.size(_c("repeat_at")) - 1, 5).otherwise(F.least(F.lit(5), F.get(_c("repeat_at"), i + 1) - p))), F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"),
        ),
    ]


#: Measure -> the steps that make it; words comes first for all.
MEASURES: dict[str, list[Step]] = {
    "n_words": [("n_words", lambda: F.size(_c("words")).cast("long"))],
    "word_chars": [("word_chars", lambda: F.length(F.array_join(_c("words"), "")).cast("long"))],
    "n_symbols": [("n_symbols", lambda: (F.length(_c("text")) - F.length(F.regexp_replace(_c("text"), r"[#*$%&|<>]", ""))).cast("long"))],
    "n_capitals": [("n_capitals", lambda: (F.length(_c("text")) - F.length(F.regexp_replace(_c("text"), r"[A-Z]+", ""))).cast("long"))],
    "n_stutters": [("n_stutters", lambda: F.size(F.filter(_c("words"), lambda w, i: F.get(_c("words"), i - 1) == w)).cast("long"))],
    "n_dup_lines": [
        ("lines", lambda: F.filter(F.split(_c("text"), "\n", -1), lambda x: x.rlike(r"[^\x09-\x0D\x20]"))),
        ("n_dup_lines", lambda: (F.size(_c("lines")) - F.size(F.array_distinct(_c("lines")))).cast("long")),
    ],
    "n_repeat_words": _repeat_steps(),
}


#: Measure -> nanoseconds for each character and each word, as measured once on one core; only their ratios matter.
COSTS = {"n_words": (0, 1), "word_chars": (1, 20), "n_symbols": (4, 0), "n_capitals": (3, 0), "n_dup_lines": (5, 0), "n_stutters": (0, 150), "n_repeat_words": (0, 650)}


@dataclass(frozen=True)
class Rule:
    """Rejects where `reject` holds; it may use n_words and its own measure."""

    name: str
    measure: str
    reject: Callable[[], Column]


#: The two rules of the contract, then those of this operator.
BASE = [
    Rule("few_words", "n_words", lambda: _c("n_words") < 10),
    Rule("repeated_words", "n_repeat_words", lambda: 100 * _c("n_repeat_words") > 20 * _c("n_words")),
]
OWN = [
    Rule("symbols", "n_symbols", lambda: 100 * _c("n_symbols") > 30 * _c("n_words")),
    Rule("repeated_lines", "n_dup_lines", lambda: 100 * _c("n_dup_lines") > 50 * F.size(_c("lines"))),
    Rule("stutters", "n_stutters", lambda: 100 * _c("n_stutters") > 30 * _c("n_words")),
    Rule("long_words", "word_chars", lambda: _c("word_chars") > 15 * _c("n_words")),
    Rule("capitals", "n_capitals", lambda: 100 * _c("n_capitals") > 40 * F.length(_c("text"))),
]


def _start(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    made = docs.withColumn("q__text", text).withColumn("q__words", F.array_remove(F.split(_c("text"), r"[\x09-\x0D\x20]+", -1), ""))
    return made.withColumn("q__n_words", F.size(_c("words")).cast("long"))


def measured(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs with a column q__<measure> for each name."""
    out, done = _start(docs), {"n_words"}
    for name in names:
        for column, made in MEASURES[name]:
            if column not in done:
                out = out.withColumn(f"q__{column}", made())
                done.add(column)
    return out


def plan(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, cost, share rejected) by falling rejections per cost, from about `sample_rows` rows of all files.

    The same table gives the same order each time.
    """
    fraction = min(1.0, sample_rows / max(1, docs.count()))
    made = measured(docs.select("text").sample(False, fraction, 11), sorted({rule.measure for rule in rules}))
    n, chars, words, *rejected = made.agg(F.count("*"), F.sum(F.length(_c("text"))), F.sum(_c("n_words")), *[F.count_if(rule.reject()) for rule in rules]).first()
    found = []
    for rule, gone in zip(rules, rejected, strict=True):
        per_char, per_word = COSTS[rule.measure]
        found.append((rule, per_char * (chars or 0) + per_word * (words or 0) + 1.0, gone / max(1, n)))
    return sorted(found, key=lambda x: (-(x[2] + 1e-4) / x[1], x[0].name))


def judged(docs: DataFrame, rules: list[Rule], whole: list[str] | None = None) -> DataFrame:
    """docs with columns q__: the verdict (the first rule in the given order that rejects the row, else null), and the measures.

    Measures named in `whole` are made for every row, the others only for rows that no earlier rule rejected.
    """
    names = whole or []
    out, done = measured(docs, names).withColumn("q__verdict", F.lit(None).cast("string")), {"n_words", *(c for n in names for c, _ in MEASURES[n])}
    for rule in rules:
        for column, made in MEASURES[rule.measure]:
            if column not in done:
                out = out.withColumn(f"q__{column}", F.when(_c("verdict").isNull(), made()))
                done.add(column)
        out = out.withColumn("q__verdict", F.coalesce(_c("verdict"), F.when(rule.reject(), F.lit(rule.name))))
    return out


def cascade(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with `rejected_by`: the first rule in the given order that rejects the row, else null."""
    apart, back = set_aside(docs, lambda c: c.startswith("q__"))
    # Not deterministic for Catalyst, so that a filter on it isn't pushed below the guarded columns, which would unfold them.
    verdict = F.when(F.spark_partition_id() >= 0, _c("verdict"))
    return judged(apart, rules).withColumn("q__verdict", verdict).select(*[c for name, c in back.items() if name.lower() != "rejected_by"], _c("verdict").alias("rejected_by"))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The rows that no rule rejects, by the planned cascade."""
    order = [rule for rule, _, _ in plan(docs, rules or [*BASE, *OWN])]
    apart, back = set_aside(docs, lambda c: c == "rejected_by")
    return cascade(apart, order).where("rejected_by is null").select(*back.values())


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]  # the result has them for every row
    rows = judged(docs, [rule for rule, _, _ in plan(docs, [*BASE, *OWN])], names)
    base = F.coalesce(*[F.when(rule.reject(), F.lit(rule.name)) for rule in BASE]).isNotNull()
    return rows.select("doc_id", _c("n_words").alias("n_words"), *[_c(n).alias(n) for n in names], base.alias("base_failed"), _c("verdict").isNull().alias("kept"))


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select r, p, md5(array_to_string(w[p : p + 4], ' ')) as h from (select r, w, unnest(range(1, len(w) - 3)) as p from w where len(w) >= 5)),
rep as (select r, count(distinct q) as n from (select r, unnest(range(p, p + 5)) as q from g join (select r, h from g group by r, h having count(*) > 1) using (r, h)) group by r),
m as (select doc_id, t, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
  cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
  len(list_filter(w, lambda x, i: i > 1 and x = w[i - 1])) as n_stutters, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_capitals, length(t) as n_chars from w left join rep using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 30 * n_words or 100 * n_dup_lines > 50 * n_lines or 100 * n_stutters > 30 * n_words or word_chars > 15 * n_words or 100 * n_capitals > 40 * n_chars) as kept
from b
"""
