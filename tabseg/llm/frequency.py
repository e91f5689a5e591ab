"""Occurrences and records of every distinct value or term (problem 3), by burst-trie counting.

Rows are first reduced to one per (column, value, record), so that record counts add up. Every worker
counts its share in a burst trie: terms hang in small containers which burst into nodes by their next
character once they hold too many, so a container's prefix is as long as the data require. Containers are
emitted as compact subtrees (prefix, suffixes, counters). Routing prefixes are then chosen from the counts
of the emitted terms, long where many terms share a beginning; subtrees that match a route meet in one
group and are merged there, container by container. A group holds at most about ROUTE_TERMS terms of every worker.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabseg.session import broadcast_if_small, materialise

#: Terms that a container holds before it bursts.
CONTAINER = 512
#: Distinct terms that a worker holds before it emits its trie and begins another.
TRIE_TERMS = 500_000
#: Emitted terms that one route may hold before its prefix is made longer.
ROUTE_TERMS = 200_000

SUBTREE = "col string, prefix string, suffixes array<string>, occurrences array<bigint>, records array<bigint>"
COUNTS = "col string, val string, occurrences bigint, records bigint"


class BurstTrie:
    """Counters of terms. A node is a dict from the next character to a node or a container; '' holds a term that ends there."""

    def __init__(self, container: int = CONTAINER) -> None:
        self.container = container
        self.root: Container | Node = Container()
        self.terms = 0

    def add(self, term: str, occurrences: int, records: int) -> None:
        node, parent, at = self.root, None, 0
        while isinstance(node, Node):
            key = term[at : at + 1]
            if key not in node.below:
                node.below[key] = Container()
            parent, node, at = (node, key), node.below[key], at + 1
        rest = term[at:]
        held = node.counts.get(rest)
        if held is not None:
            held[0] += occurrences
            held[1] += records
            return
        node.counts[rest] = [occurrences, records]
        self.terms += 1
        if len(node.counts) > self.container and rest:
            self._burst(node, parent)

    def graft(self, prefix: str, counts: dict[str, list[int]]) -> None:
        """Merge a subtree, given by its prefix and the counters of its suffixes, with what this trie holds there."""
        node, parent, at = self.root, None, 0
        while isinstance(node, Node) and at < len(prefix):
            key = prefix[at]
            if key not in node.below:
                node.below[key] = Container()
            parent, node, at = (node, key), node.below[key], at + 1
        if isinstance(node, Node):  # this trie is deeper here: the subtree parts by its next character
            parts: dict[str, dict[str, list[int]]] = {}
            for rest, c in counts.items():
                parts.setdefault(rest[:1], {})[rest[1:]] = c
            for key, part in parts.items():
                if key:
                    self.graft(prefix + key, part)
                else:
                    self.add(prefix, *part[""])
            return
        lead, held = prefix[at:], node.counts
        for rest, c in counts.items():
            own = held.get(lead + rest)
            if own is None:
                held[lead + rest] = list(c)
                self.terms += 1
            else:
                own[0] += c[0]
                own[1] += c[1]
        while len(node.counts) > self.container and any(node.counts):
            self._burst(node, parent)
            inner = self.root if parent is None else parent[0].below[parent[1]]
            key, below = max(inner.below.items(), key=lambda x: len(x[1].counts))
            node, parent = below, (inner, key)
            if key == "":
                break

    def _burst(self, full: Container, parent: tuple[Node, str] | None) -> None:
        node = Node()
        for rest, counts in full.counts.items():
            node.below.setdefault(rest[:1], Container()).counts[rest[1:]] = counts
        if parent is None:
            self.root = node
        else:
            parent[0].below[parent[1]] = node

    def subtrees(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        """Prefix and counters of each container."""
        stack: list[tuple[str, Container | Node]] = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if isinstance(node, Node):
                stack.extend((prefix + key, below) for key, below in node.below.items())
            elif node.counts:
                yield prefix, node.counts


class Container:
    __slots__ = ("counts",)

    def __init__(self) -> None:
        self.counts: dict[str, list[int]] = {}


class Node:
    __slots__ = ("below",)

    def __init__(self) -> None:
        self.below: dict[str, Container | Node] = {}


def _emit(tries: dict[str, BurstTrie]) -> Iterator[pa.RecordBatch]:
    rows = [(col, prefix, list(c), [x[0] for x in c.values()], [x[1] for x in c.values()]) for col, trie in tries.items() for prefix, c in trie.subtrees()]
    for i in range(0, len(rows), 256):
        part = list(zip(*rows[i : i + 256]))
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(part, kinds)], names=["col", "prefix", "suffixes", "occurrences", "records"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[str, BurstTrie] = {}
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["col", "val"]).aggregate([("n", "sum"), ("r", "sum")])
        for col, val, n, r in zip(*(t.column(c).to_pylist() for c in ("col", "val", "n_sum", "r_sum"))):
            tries.setdefault(col, BurstTrie()).add(val, n, r)
        if sum(t.terms for t in tries.values()) > TRIE_TERMS:
            yield from _emit(tries)
            tries = {}
    yield from _emit(tries)


def _routes(subtrees: DataFrame, limit: int) -> list[tuple[str, str, int]]:
    """(column, prefix, parts): prefixes that hold many terms are routes of their own; what is left of a prefix when its large continuations
    have routes is dealt into parts by the next character, so that no part covers much more than `limit` emitted terms."""
    open_: list[tuple[str, str]] | None = None
    size: dict[tuple[str, str], int] = {}
    terms = None
    depth = 0
    while open_ is None or open_:
        if open_ is None:
            found = [(r["col"], "", r["n"]) for r in subtrees.groupBy("col").agg(F.sum(F.size("suffixes")).alias("n")).collect()]
        else:
            terms = terms if terms is not None else subtrees.select("col", F.explode(F.transform("suffixes", lambda s: F.concat("prefix", s))).alias("val"))
            within = terms.sparkSession.createDataFrame(open_, "col string, cut string")
            cut = terms.withColumn("cut", F.substring("val", 1, depth - 1)).join(broadcast_if_small(within), ["col", "cut"]).where(F.length("val") >= depth)
            found = [(r["col"], r["p"], r["n"]) for r in cut.groupBy("col", F.substring("val", 1, depth).alias("p")).agg(F.count("*").alias("n")).where(F.col("n") > limit // 16).collect()]
        for c, p, n in found:
            size[c, p] = n
        open_ = [(c, p) for c, p, n in found if n > limit]
        depth += 1
    rest = dict(size)
    for c, p in size:
        if p:
            rest[c, p[:-1]] -= size[c, p]
    return [(c, p, max(-(-rest[c, p] // limit), 1)) for c, p in size]


def count_values(rows: DataFrame, route_terms: int = ROUTE_TERMS) -> DataFrame:
    """Occurrences (rows) and records (distinct `record`) of each value; rows: columns col, val, record.

    Rows without a value are left out; rows without a record count as occurrences only. An empty table
    gives an empty result. Values are compared as they are, so readings are normalised by the caller.
    """
    single = (
        rows.where(F.col("val").isNotNull()).groupBy("col", "val", "record").agg(F.count("*").alias("n"))
        .select("col", "val", "n", F.col("record").isNotNull().cast("bigint").alias("r"))
    )
    subtrees = materialise(single.mapInArrow(_count, SUBTREE))
    routes: dict[str, dict[int, dict[str, int]]] = {}
    for col, prefix, parts in _routes(subtrees, route_terms):
        routes.setdefault(col, {}).setdefault(len(prefix), {})[prefix] = parts

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for col, prefix, suffixes, n, r in b.itertuples(index=False):
                by: dict[str, list[int]] = {}
                known = routes[col]
                for i, s in enumerate(suffixes):
                    term = prefix + s
                    to = next(term[:k] for k in sorted(known, reverse=True) if term[:k] in known[k])
                    parts = known[len(to)][to]
                    by.setdefault(to if parts == 1 else f"{to}\x1f{zlib.crc32(term[len(to) : len(to) + 1].encode()) % parts}", []).append(i)
                out += [(col, to, prefix, np.asarray(suffixes)[at], np.asarray(n)[at], np.asarray(r)[at]) for to, at in by.items()]
            yield pd.DataFrame(out, columns=["col", "route", "prefix", "suffixes", "occurrences", "records"])

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        trie = BurstTrie()
        for prefix, suffixes, n, r in part[["prefix", "suffixes", "occurrences", "records"]].itertuples(index=False):
            trie.graft(prefix, {s: [int(a), int(c)] for s, a, c in zip(suffixes, n, r)})
        return pd.DataFrame([(key[0], prefix + s, c[0], c[1]) for prefix, held in trie.subtrees() for s, c in held.items()], columns=["col", "val", "occurrences", "records"])

    return subtrees.mapInPandas(route, SUBTREE.replace("prefix", "route string, prefix", 1)).groupBy("col", "route").applyInPandas(merge, COUNTS)


def stated_records(rows: DataFrame) -> DataFrame:
    """Distinct records with any value, per column."""
    return rows.where(F.col("val").isNotNull() & F.col("record").isNotNull()).groupBy("col", "record").agg(F.lit(1).alias("one")).groupBy("col").agg(F.count("*").alias("total"))


def mark_values(counts: DataFrame, totals: DataFrame, limits: DataFrame) -> DataFrame:
    """Counts with `mark`: 'rare' below min_records, 'common' above max_share of the column's stated records.

    limits: col, min_records, max_share (null: no such limit). A value that is both comes out twice; one
    that is neither has mark null.
    """
    x = counts.join(F.broadcast(totals), "col").join(F.broadcast(limits), "col")
    rare = F.when(F.col("records") < F.col("min_records"), "rare")
    common = F.when(F.col("records") > F.col("max_share") * F.col("total"), "common")
    marks = F.filter(F.array(rare, common), lambda m: m.isNotNull())
    return x.withColumn("mark", F.explode_outer(marks)).select("col", "val", "occurrences", "records", "total", "mark")
