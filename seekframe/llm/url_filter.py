"""URL rules by a sort-merge range join (operator 6).

A host's labels are reversed (``www.example.com`` becomes ``com.example.www.``), so
that a rule's host with all its subdomains is one interval of keys.  Urls and rules
are swept together in key order; a stack holds the rules whose intervals enclose the
current key, innermost on top, and within one host a second sweep does the same for
path prefixes.  The longest rule that fits wins (host and path together; then the
longer host).

Results: a null url, or one without ``://``, has an empty host and path, and no rule
fits it.  A url without a path has the empty path, which a rule's ``/`` doesn't begin.
Rows that no rule fits have a null rule and the default verdict.  Repeated rows give
repeated results; an empty table or an empty rule list is fine; further columns are
kept only if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that travel with each task; a larger rule table is dealt out beside the urls.
LOCAL_RULES = 100_000
#: Urls in one group where rules are dealt out.
GROUP_URLS = 50_000

Rule = tuple[str, str, str]  # verdict, host, path


def split_url(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a url; both empty if there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


def _enclosing(urls: list[str], rules: list[tuple[str, object]]) -> Iterator[tuple[str, list]]:
    """For each sorted url key, the payloads of the rules whose key begins it, outermost first.

    Both lists are sorted and free of repeats; this is the sweep with its stack.
    """
    stack: list[tuple[str, object]] = []
    at = 0
    for key in urls:
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        yield key, [payload for _, payload in stack]


class RuleSweep:
    """Rules sorted by host key, and by path within a host."""

    def __init__(self, rules: Sequence[Rule]):
        by_host: dict[str, dict[str, tuple[str, str]]] = {}
        for verdict, host, path in rules:
            by_host.setdefault(host_key(host), {}).setdefault(path, (f"{host}{path}", verdict))
        by_host.pop("", None)
        self.hosts = [(key, (len(key), sorted(paths.items()))) for key, paths in sorted(by_host.items())]

    def run(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """(rule, verdict) of each url, in the order given."""
        keys = [*map(host_key, hosts)]
        order = sorted(range(len(keys)), key=lambda i: (keys[i], paths[i]))
        out: list[tuple[str, str] | None] = [None] * len(keys)
        active = dict(_enclosing(sorted(set(keys)), self.hosts))
        for key, group in groupby(order, key=keys.__getitem__):
            levels = active[key]
            if not levels or not key:
                continue
            rows = [*group]
            best: dict[str, tuple[int, int, tuple[str, str]]] = {}
            for width, rules in levels:
                own = [(p, (p, rule)) for p, rule in rules]
                for path, found in _enclosing(sorted({paths[i] for i in rows}), own):
                    if found:
                        prefix, rule = found[-1]
                        best[path] = max(best.get(path, (-1, -1, rule)), (width + len(prefix), width, rule))
            for i in rows:
                if paths[i] in best:
                    out[i] = best[paths[i]][2]
        return out


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", local_rules: int = LOCAL_RULES) -> DataFrame:
    """id, host, path, rule and verdict of each url.

    ``rules`` is a list of (verdict, host, path) or a table with those columns.  Up to
    ``local_rules`` of them travel with every task, which then sorts and sweeps its own
    rows without a shuffle.  More are dealt out with the urls by the last two labels of
    the host; urls of a common pair of labels are spread over several groups, each of
    which gets that pair's rules.
    """
    host, path = split_url(F.col(url_col))
    keyed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    salt = F.xxhash64(F.col(id_col), F.col(url_col))  # the same however often a task is run
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, host string, path string, rule string, verdict string"

    def judged(batch: pa.RecordBatch | pa.Table, sweep: RuleSweep) -> pa.RecordBatch | pa.Table:
        found = sweep.run(batch.column("host").to_pylist(), batch.column("path").to_pylist())
        rule = pa.array([f and f[0] for f in found], pa.string())
        verdict = pa.array([f[1] if f else default for f in found], pa.string())
        return type(batch).from_arrays([batch.column(id_col), batch.column("host"), batch.column("path"), rule, verdict], [id_col, "host", "path", "rule", "verdict"])

    if isinstance(rules, DataFrame):
        rules = rules.select("verdict", "host", "path")
        head = [tuple(r) for r in rules.limit(local_rules + 1).collect()]
        if len(head) > local_rules:
            return _dealt(pages.select(F.col(id_col), host.alias("host"), path.alias("path"), salt.alias("salt")), rules, judged, schema)
        rules = head
    sweep = RuleSweep(rules)
    return keyed.mapInArrow(lambda batches: (judged(b, sweep) for b in batches), schema)


def _dealt(keyed: DataFrame, rules: DataFrame, judged, schema: str) -> DataFrame:
    pair = lambda c: F.substring_index(c, ".", -2)
    keyed = keyed.withColumn("pair", pair("host"))
    sizes = keyed.groupBy("pair").agg(F.ceil(F.count(F.lit(1)) / GROUP_URLS).cast("int").alias("parts"))
    urls = keyed.join(sizes, "pair").withColumn("part", F.pmod(F.col("salt"), F.col("parts")))
    narrow = rules.where(F.instr("host", ".") > 0).withColumn("pair", pair("host")).join(sizes, "pair")
    wide = rules.where(F.instr("host", ".") == 0).join(sizes.withColumn("host", F.substring_index("pair", ".", -1)), "host")
    dealt = narrow.unionByName(wide.select(narrow.columns)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = (right.column(c).to_pylist() for c in ("verdict", "host", "path"))
        return judged(left, RuleSweep([*zip(*columns, strict=True)]))

    urls = urls.select(F.col("pair").alias("pair"), F.col("part").cast("bigint").alias("part"), *[F.col(c).alias(c) for c in urls.columns if c not in ("pair", "part", "parts", "salt")])
    dealt = dealt.select(F.col("pair").alias("pair"), F.col("part").cast("bigint").alias("part"), "verdict", "host", "path")
    return urls.groupBy("pair", "part").cogroup(dealt.groupBy("pair", "part")).applyInArrow(both, schema)
