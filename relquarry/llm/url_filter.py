"""Allow and block rules for URLs in a trie over reversed host labels and path segments.

A rule is a host and a path. It fits its host and all subdomains, where the URL's path
starts with the rule's. Of the rules that fit, the longest host wins, then the longest
path; a block wins over an allow for the very same host and path. URLs that no rule fits
get the default verdict.

The trie's first levels are host labels from the right, then come path segments; a node
holds the verdict of the rule that ends there. The rules are broadcast, MAX_RULES of them
at a time: more are judged block by block, and a URL carries the best rule so far from
pass to pass, which gives the same verdicts.

Defined results. Null URL, or one without "://": host and path are empty and no rule fits
(a rule's path starts with "/"). Empty and very long URLs, repeated rows: each by itself.
Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, keep, prepare

MAX_RULES = 1_000_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_OUT = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("labels", pa.int32()), ("length", pa.int32())])


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class RuleTrie:
    """rules: (verdict, host, path) with path from its first "/" on; an empty host fits every host."""

    def __init__(self, rules):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("." + label, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            # the last segment of a rule is a prefix of the URL's: keyed by its length
            prefixes = node.setdefault("prefixes", {})
            old = prefixes.setdefault(len(last), {}).get(last)
            if old is None or verdict == "block":
                prefixes[len(last)][last] = (verdict, f"{host}{path}", host.count(".") + 1 if host else 0, len(path))

    def find(self, host: str, path: str):
        """The verdict, text, number of host labels and path length of the rule that wins, or None."""
        node, best = self.root, None
        segments = path.split("/")
        best = self._path(node, segments) or best
        for label in reversed(host.split(".")):
            node = node.get("." + label)
            if node is None:
                break
            best = self._path(node, segments) or best
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]):
        best = None
        for i, segment in enumerate(segments):
            for n, of in sorted(node.get("prefixes", {}).items()):
                best = of.get(segment[:n], best) if n <= len(segment) else best
            node = node.get("/" + segment) if i < len(segments) - 1 else None
            if node is None:
                break
        return best


_tries: dict[int, RuleTrie] = {}


def _judge(batches, rules, key: int):
    """Rows (id, host, path, and the rule, verdict, labels and length of the best so far)."""
    if key not in _tries:
        _tries.clear()
        _tries[key] = RuleTrie(rules.value)
    find = _tries[key].find
    for b in batches:
        best = []
        for host, path, *old in zip(*(b.column(c).to_pylist() for c in _OUT.names[1:])):
            new = find(host, path)
            if new and (old[2] is None or (new[2], new[3], new[0] == "block") > (old[2], old[3], old[1] == "block")):
                old = new[1], *new[:1], *new[2:]
            best.append(old)
        rule, verdict, labels, length = zip(*best) if best else ([],) * 4
        yield batch(_OUT, b.column("id"), b.column("host"), b.column("path"), rule, verdict, labels, length)


def _split(batches):
    for b in batches:
        parts = [split_url(u) for u in b.column(1).to_pylist()]
        none = [None] * b.num_rows
        yield batch(_OUT, b.column(0), [h for h, _ in parts], [p for _, p in parts], none, none, none, none)


def _first(batches, rules, key: int):
    return _judge(_split(batches), rules, key)


def judge_urls(urls: DataFrame, rules, default: str = "allow", key: str = "page_id") -> DataFrame:
    """key, host, path, rule (host and path of the one that wins, else null), verdict, of every row."""
    spark = urls.sparkSession
    prepare(spark)
    rules = tuple(sorted(map(tuple, rules)))
    out = urls.select(F.col(key).cast("bigint").alias("id"), F.col("url").cast("string").alias("url"))
    blocks = [rules[i : i + MAX_RULES] for i in range(0, max(1, len(rules)), MAX_RULES)]
    for k, block in enumerate(blocks):
        table = spark.sparkContext.broadcast(block)
        step = _judge if k else _first
        if k:  # one block's trie at a time in a worker
            out = keep(out)
        out = out.mapInArrow(partial(step, rules=table, key=uuid.uuid4().int), "id bigint, host string, path string, rule string, verdict string, labels int, length int")
    return out.select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
