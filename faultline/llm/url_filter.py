"""URL allow and block lists in one trie.

The trie runs over a rule's reversed host labels (org, example, www), then over
its path segments; a path's last segment is matched as a prefix. All rules on a
url's way through the trie fit it, and the one of most characters decides. The
rules are a list on the driver, sent to the tasks; more than `max_rules` is an
error, never a truncation.

A url's host lies after the first "://" up to "/", "?", "#" or the end, with A-Z
lower-cased; its path follows up to "?", "#" or the end. A null url or one
without "://" has an empty host and path. Without a fitting rule the verdict is
`default`. Rows are judged one by one: nulls, repeated rows, other columns and
empty tables need nothing else; a url of any length is read
once. Two rules with one host and path are an error.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rules of the registered query, as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT = "allow"
_HOST = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = {c: c + 32 for c in range(65, 91)}


class Node:
    __slots__ = ("labels", "paths")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}
        self.paths: Path | None = None


class Path:
    __slots__ = ("segments", "ends")

    def __init__(self) -> None:
        self.segments: dict[str, Path] = {}
        self.ends: list[tuple[str, Rule]] = []  # (start of the next segment, rule), longest first


class Rule(NamedTuple):
    name: str
    verdict: str


def build(rules: list[tuple[str, str, str]], max_rules: int = 1_000_000) -> Node:
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are sent to every task")
    if len({(h.translate(_LOWER), p) for _, h, p in rules}) < len(rules):
        raise ValueError("two rules have one host and path")
    root = Node()
    for verdict, host, path in rules:
        host = host.translate(_LOWER)
        node = root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, Node())
        node.paths = node.paths or Path()
        at = node.paths
        *whole, last = path.split("/")
        for segment in whole:
            at = at.segments.setdefault(segment, Path())
        at.ends.append((last, Rule(host + path, verdict)))
        at.ends.sort(key=lambda e: -len(e[0]))
    return root


def _deepest(at: Path, segments: list[str]) -> Rule | None:
    best = None
    for segment in segments:
        best = next((r for start, r in at.ends if segment.startswith(start)), best)
        if segment not in at.segments:
            break
        at = at.segments[segment]
    return best


def judge(root: Node, host: str, path: str) -> Rule | None:
    node, best = root, None
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        if node.paths and (r := _deepest(node.paths, segments)) and (best is None or len(r.name) >= len(best.name)):
            best = r
    return best


def split_url(url: str | None) -> tuple[str, str]:
    m = _HOST.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def _run(batches, root: Node, default: str):
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for url in batch.column("url").to_pylist():
            host, path = split_url(url)
            rule = judge(root, host, path) if host else None
            for column, value in zip(rows, (host, path, rule and rule.name, rule.verdict if rule else default), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in rows)], names=["page_id", "host", "path", "rule", "verdict"])


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (host and path; null if none fits), verdict of each row."""
    root = build(rules)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    return rows.mapInArrow(lambda batches: _run(batches, root, default), "page_id long, host string, path string, rule string, verdict string")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES)


ORACLE = r"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw_host, rest from u),
p as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from h),
r(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (select page_id, arg_max(rhost || rpath, length(rhost || rpath)) as rule, arg_max(verdict, length(rhost || rpath)) as verdict
  from p join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join best on p.page_id = best.page_id
"""
