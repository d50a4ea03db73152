"""URL filters: sort-merge range join of urls with nested prefix rules.

A rule (verdict, host, path) fits its host and every subdomain when the url's path starts
with the rule's path.  Written with its labels reversed and a dot after each, a rule's host
is a prefix of the key of every host it fits, so it covers one interval of sorted keys,
and two such intervals are nested or disjoint.  Urls are range-partitioned and sorted by
that key; one sweep per partition advances through the sorted rules and keeps a stack of
the rule hosts whose interval is open.  Each open host holds its path prefixes; the url
takes the longest rule (host and path together, then the longer host; of a rule given twice
with both verdicts, block).

The sort key ends with a hash of the url and the page id, so a host, or one url, that
holds a third of all rows is spread over many partitions.  Only the url column is moved.
Rules are a stated list; it is broadcast in blocks of ``RULES_AT_ONCE`` and the sorted
partitions are swept once per block without another shuffle, so memory does not grow
with the list.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no
rule and gets the default verdict; each row gives one row; rules whose host is empty fit
no url.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RULES_AT_ONCE = 200_000
Rule = tuple[str, str, str]  # verdict, host, path


def url_host(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url):
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host):
    """Labels reversed, a dot after each."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def reversed_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class OpenHost:
    """A rule host on the stack with its path prefixes by length."""

    def __init__(self, key: bytes, host: str):
        self.key, self.host = key, host
        self.by_path: dict[str, str] = {}
        self.lengths: list[int] = []

    def add(self, verdict: str, path: str) -> None:
        if self.by_path.get(path) != "block":
            self.by_path[path] = verdict
        self.lengths = sorted({len(p) for p in self.by_path}, reverse=True)

    def longest(self, path: str) -> str | None:
        for n in self.lengths:
            if n <= len(path) and path[:n] in self.by_path:
                return path[:n]
        return None


def sorted_hosts(rules: Sequence[Rule]) -> list[OpenHost]:
    hosts: dict[str, OpenHost] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError("a rule's verdict is allow or block")
        host = host.translate(str.maketrans(common.UPPER, common.LOWER))
        if host:
            hosts.setdefault(host, OpenHost(reversed_host(host).encode(), host)).add(verdict, path)
    return sorted(hosts.values(), key=lambda h: h.key)


class Sweep:
    """Sorted keys in, innermost matching rule out; the state is the stack and a rule pointer."""

    def __init__(self, hosts: list[OpenHost]):
        self.hosts, self.at, self.stack = hosts, 0, []

    def match(self, key: bytes, path: str) -> tuple[str, str, int, int] | None:
        """(rule, verdict, length, host length) of the longest rule that fits."""
        stack, hosts = self.stack, self.hosts
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        while self.at < len(hosts) and hosts[self.at].key <= key:
            if key.startswith(hosts[self.at].key):
                stack.append(hosts[self.at])
            self.at += 1
        best = None
        for entry in stack:
            p = entry.longest(path)
            if p is not None:
                size = (len(entry.host) + len(p), len(entry.host))
                if best is None or size > best[2:]:
                    best = (entry.host + p, entry.by_path[p], *size)
        return best


def filter_urls(df: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` of every row; ``rule`` is null when none fits."""
    url = F.col("_url")
    rows = df.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    rows = rows.select("_id", url_host(url).alias("host"), url_path(url).alias("path"), F.xxhash64("_url", "_id").alias("_salt"))
    rows = rows.withColumn("_key", host_key(F.col("host")))
    rows = rows.repartitionByRange("_key", "_salt").sortWithinPartitions("_key")
    best = "_rule string, _verdict string, _len int, _hlen int"
    rows = rows.selectExpr("_id", "_key", "host", "path", "cast(null as string) _rule", "cast(null as string) _verdict",
                           "0 as _len", "0 as _hlen")
    id_type = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, _key string, host string, path string, {best}"
    target = common.arrow_schema(rows.schema)
    context = df.sparkSession.sparkContext
    common.ship(df.sparkSession)
    hosts = sorted_hosts(rules)

    for k in range(0, len(hosts), RULES_AT_ONCE):
        block = context.broadcast(hosts[k:k + RULES_AT_ONCE])

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            sweep = Sweep(block.value)
            for batch in batches:
                found = []
                held = [batch.column(i).to_pylist() for i in range(4, 8)]
                for key, path, *old in zip(common.byte_values(batch.column(1)), batch.column(3).to_pylist(), *held):
                    new = sweep.match(key, path)
                    found.append(new if new and new[2:] > (old[2], old[3]) else old)
                cols = [c.cast(f.type) for c, f in zip(batch.columns[:4], target)]
                cols += [pa.array([x[i] for x in found], target.field(4 + i).type) for i in range(4)]
                yield pa.RecordBatch.from_arrays(cols, schema=target)

        rows = rows.mapInArrow(run, schema)
    return rows.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule").alias("rule"),
                       F.coalesce("_verdict", F.lit(default)).alias("verdict"))
