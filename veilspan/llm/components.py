"""Connected components by union-find within partitions and star contraction between them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import staged


class UnionFind:
    """Roots are the smallest members."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.parent[high] = low
            self.parent.setdefault(low, low)


#: Links that a task holds before it lets its forest go.
_HELD = 200_000


def _forests(edges: DataFrame) -> DataFrame:
    """(node, root) of the forest that each task finds in its links; bounded memory: a task starts a
    new forest after so many links."""
    schema = "node binary, root binary"

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = UnionFind(), 0

        def out() -> pa.RecordBatch:
            rows = [(x, sets.find(x)) for x in sets.parent]
            rows = [(x, r) for x, r in rows if x != r]
            return pa.record_batch([pa.array([x for x, _ in rows], pa.binary()), pa.array([r for _, r in rows], pa.binary())], ["node", "root"])

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sets.union(x, y)
            held += b.num_rows
            if held >= _HELD:
                yield out()
                sets, held = UnionFind(), 0
        yield out()

    return edges.mapInArrow(forest, schema)


def name_of(row_id: int | None, digest: bytes) -> bytes:
    """A node's name: bytewise order is the order of ids, null ids last."""
    return (b"\1" + bytes(8) if row_id is None else b"\0" + struct.pack(">Q", row_id + (1 << 63))) + digest


def name_column(row_id: Column, digest: Column) -> Column:
    """``name_of`` as a Column."""
    place = F.lpad(F.hex(row_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(F.when(row_id.isNull(), F.lit("01" + "00" * 8)).otherwise(F.concat(F.lit("00"), place))), digest)


def id_of(name: Column) -> Column:
    """The id in a name; null for a null id."""
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", number)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two binary columns) but the roots themselves; a
    root is the smallest node of its component, so with ``name_of`` it holds the component's least id.

    Links go from a node to a smaller one.  Each round hangs every node on the smallest neighbour of
    the ones it hangs on, then all that a node hangs on on the smallest of them: minima are partial
    aggregates over the larger ends, and the joins are ones that adaptive execution splits, so a node
    that very many others hang on fills no task.  Rounds are logarithmic in practice; each is staged in
    the shared folder.  It ends when every node has one root and no root hangs on another.
    """
    now = staged(_forests(edges).distinct(), "forest")
    while True:
        counted = now.agg(F.count("*"), F.count_distinct("node")).first()
        if counted[0] == counted[1] and now.join(now.select(F.col("node").alias("root")), "root", "left_semi").isEmpty():
            return now
        least = now.groupBy(F.col("node").alias("root")).agg(F.min("root").alias("m"))
        large = staged(now.join(least, "root", "left").select("node", F.coalesce("m", "root").alias("root")).distinct(), "large-star")
        smallest = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(smallest, "node").where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root")).unionByName(smallest.select("node", F.col("m").alias("root")))
        now = staged(small.distinct(), "small-star")
