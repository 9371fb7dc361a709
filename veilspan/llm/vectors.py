"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe.

A vector is rotated by three rounds of random signs and a Hadamard transform; its hash is the nearest
signed axis.  A table's bucket joins several such hashes, the last of them over a part of the axes, so
that there are about as many buckets as vectors at every size.  A vector lives in its own bucket and
looks into those where one of its hashes is replaced by its next nearest axes.  Every pair in which one
looks where the other lives is compared in double precision, in the first table (and the smaller
vector's bucket) that brings it together, so links are counted once and never gathered as pairs.

Equal vectors form a class and go on as one node with a weight, named by its least id and a fingerprint, so
the smallest node of a component holds the component's id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import staged
from veilspan.llm.components import UnionFind, components, id_of, name_column

COSINE = 0.9
#: Axes tried for each hash; the chance of missing a pair of the least cosine that the tables allow.
AXES, MISS = 3, 2e-4
#: Pairs and tables that the chance of meeting in a table is measured on, and standard deviations it is
#: lowered by.
MEASURED_PAIRS, MEASURED_TABLES, MARGIN = 1000, 4, 3
#: Rows of a bucket that are compared in one go; larger buckets are cut into blocks, block by block.
BLOCK = 1024
#: Groups of up to so many rows are compared together, larger ones each by a matrix product.
_SMALL = 48


def padded_size(dimensions: int) -> int:
    return 1 << max(1, (dimensions - 1).bit_length())


@lru_cache(maxsize=64)
def meeting(size: int, hashes: int, last: int, cosine: float) -> float:
    """Chance that a table brings a pair of that cosine together, measured on seeded pairs of that (padded)
    size, less ``MARGIN`` standard deviations: rotated vectors are alike whatever was padded."""
    rng = np.random.default_rng([5, size, hashes, last])
    x = rng.normal(size=(MEASURED_PAIRS, size))
    z = rng.normal(size=x.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cells = cross_polytope(np.concatenate([x, cosine * x + math.sqrt(1 - cosine * cosine) * z]), hashes, last, MEASURED_TABLES)
    one, other, _ = sees(cells[:MEASURED_PAIRS], cells[MEASURED_PAIRS:])
    p = float((one | other).mean())
    return min(max(p - MARGIN * math.sqrt(p * (1 - p) / (MEASURED_PAIRS * MEASURED_TABLES)), 0.01), 0.999)


def plan(n: int, size: int = 64, cosine: float = COSINE) -> tuple[int, int, int]:
    """Whole hashes of a table, axes of the last hash (0: none) for about as many buckets as vectors, and
    tables for the chance ``MISS``."""
    hashes = max(1, int(math.log(max(n, 2)) / math.log(2 * size)))
    rest = n // (2 * size) ** hashes
    last = min(size // 2, 1 << (rest.bit_length() - 2)) if rest >= 2 else 0
    return hashes, last, math.ceil(math.log(MISS) / math.log(1 - meeting(size, hashes, last, cosine)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def cross_polytope(x: np.ndarray, hashes: int, last: int, tables: int, axes: int = AXES, seed: int = 11) -> np.ndarray:
    """Nearest signed axes (vectors, tables, hashes, axes), the nearest first, of every hash; the last hash
    is over ``last`` axes only (if any).  A place without an axis holds the kind's largest number."""
    n, d = x.shape
    size = padded_size(d)
    padded = np.zeros((n, size))
    padded[:, :d] = x
    rng = np.random.default_rng([seed, size])
    kind = np.uint8 if 2 * size < 255 else np.uint16 if 2 * size < 65535 else np.uint32
    out = np.full((n, tables, hashes + (last > 0), axes), np.iinfo(kind).max, kind)
    for t in range(tables):
        for k in range(out.shape[2]):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), size))
            y = y if k < hashes else y[:, :last]
            signed = np.stack([-y, y], axis=2).reshape(n, -1)  # cell: 2 * axis, and 1 more for the positive side
            m = min(axes, signed.shape[1])
            near = np.argpartition(-signed, m - 1, axis=1)[:, :m] if m < signed.shape[1] else np.broadcast_to(np.arange(m), (n, m))
            order = np.argsort(-np.take_along_axis(signed, near, 1), axis=1, kind="stable")
            out[:, t, k, :m] = np.take_along_axis(near, order, 1)
    return out


def sees(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of two cell arrays and each table: whether p looks where q lives, whether q looks where p
    lives, and whether both live in one bucket."""
    equal = p[..., 0] == q[..., 0]
    near = (~equal).sum(axis=-1) <= 1
    p_sees = near & (equal | (p[..., 1:] == q[..., :1]).any(axis=-1)).all(axis=-1)
    q_sees = near & (equal | (q[..., 1:] == p[..., :1]).any(axis=-1)).all(axis=-1)
    return p_sees, q_sees, equal.all(axis=-1)


def bucket_codes(cells: np.ndarray, dimensions: int) -> np.ndarray:
    """Codes (vectors, tables, 1 + hashes * (axes - 1)) of the own bucket, then of those looked into: the
    table's number above 48 bits of a hash.  Places without an axis give the own bucket again."""
    n, tables, hashes, axes = cells.shape
    factor = np.random.default_rng([17, hashes]).integers(1 << 40, 1 << 62, hashes + 1, dtype=np.int64) | 1
    c = cells.astype(np.int64)
    own = (c[..., 0] * factor[:hashes]).sum(axis=2) + (np.array([dimensions]) * factor[hashes:]).sum()
    out = np.empty((n, tables, 1 + hashes * (axes - 1)), np.int64)
    out[..., 0] = own
    absent = cells == np.iinfo(cells.dtype).max
    for k in range(hashes):
        for j in range(1, axes):
            out[..., 1 + k * (axes - 1) + j - 1] = own + np.where(absent[:, :, k, j], 0, (c[:, :, k, j] - c[:, :, k, 0]) * factor[k])
    # the high bits of the product are the mixed ones
    return (out >> 16 & (1 << 48) - 1) + (np.arange(tables, dtype=np.int64) << 48)[:, None]


class _Rows:
    """Rows of groups, by group and node, as arrays."""

    FIELDS = ("group", "split", "node", "own", "size", "block", "table", "cells", "vector")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    def __len__(self) -> int:
        return len(self.group)

    def part(self, at) -> _Rows:
        return _Rows(**{f: getattr(self, f)[at] for f in self.FIELDS})

    @classmethod
    def joined(cls, parts: list[_Rows]) -> _Rows:
        return parts[0] if len(parts) == 1 else cls(**{f: np.concatenate([getattr(p, f) for p in parts]) for f in cls.FIELDS})


def _pairs(rows: _Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows of one group of which one lives there, of different blocks where the group is of
    two, whose cosine is to be had; groups are put together by their distance of rows."""
    starts = np.flatnonzero(np.r_[True, rows.group[1:] != rows.group[:-1]])
    sizes = np.diff(np.r_[starts, len(rows)])
    small = np.repeat(sizes <= _SMALL, sizes)
    for k in range(1, min(_SMALL, int(sizes.max(initial=1)))):
        i = np.flatnonzero(small[k:] & (rows.group[k:] == rows.group[:-k]))
        j = i + k
        fits = (rows.own[i] | rows.own[j]) & (~rows.split[i] | (rows.block[i] != rows.block[j]))
        if fits.any():
            yield i[fits], j[fits]


def _links(rows: _Rows, cosine: float) -> list[tuple[bytes, int, bytes]]:
    """(node, linked weight, root) of the nodes that these whole groups link."""
    norm = np.sqrt((rows.vector * rows.vector).sum(axis=1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in _pairs(rows):
        for at in range(0, len(i), 8192):
            p, q = i[at : at + 8192], j[at : at + 8192]
            close = np.einsum("ij,ij->i", rows.vector[p], rows.vector[q]) / (norm[p] * norm[q]) >= cosine
            found.append((p[close], q[close]))
    starts = np.flatnonzero(np.r_[True, rows.group[1:] != rows.group[:-1]])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
        if b - a > _SMALL:
            v, own, block = rows.vector[a:b], rows.own[a:b], rows.block[a:b]
            close = (v @ v.T) / (norm[a:b, None] * norm[None, a:b]) >= cosine
            close &= own[:, None] | own[None, :]
            close &= np.triu(np.ones(close.shape, bool), 1)
            if rows.split[a]:
                close &= block[:, None] != block[None, :]
            p, q = np.nonzero(close)
            found.append((p + a, q + a))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
    here = np.zeros(len(i), bool)
    for at in range(0, len(i), 20_000):
        p, q = i[at : at + 20_000], j[at : at + 20_000]
        p_sees, q_sees, same = sees(rows.cells[p], rows.cells[q])
        t, k = rows.table[p], np.arange(len(p))
        # both look at each other from different buckets: the one where the smaller node (the rows
        # are in its order) lives counts
        both = p_sees[k, t] & q_sees[k, t] & ~same[k, t]
        here[at : at + 20_000] = ((p_sees | q_sees).argmax(axis=1) == t) & (~both | rows.own[p])
    i, j = i[here], j[here]
    weight = np.zeros(len(rows), np.int64)
    np.add.at(weight, i, rows.size[j])
    np.add.at(weight, j, rows.size[i])
    sets = UnionFind()
    names = {k: rows.node[k].tobytes() for k in np.flatnonzero(weight).tolist()}
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        sets.union(names[p], names[q])
    return [(name, int(weight[k]), sets.find(name)) for k, name in names.items()]


def _dealt_rows(b: pa.RecordBatch, plans: dict[int, tuple[int, int, int]]) -> Iterator[tuple[int, _Rows]]:
    """Rows of a batch by the vectors' dimensions, codes that fall together merged."""
    bucket, low, high, block, own, size, width, dims = (b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "low", "high", "block", "own", "size", "width", "dims"))
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        node = np.frombuffer(b"".join(b.column("node").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
        values = b.column("value").take(pa.array(at)).to_pylist()
        wide = width[at]
        if (wide == 4).all():
            vector = np.frombuffer(b"".join(values), "<f4").astype(float).reshape(-1, d)
        else:
            vector = np.stack([np.frombuffer(v, "<f4" if w == 4 else "<f8").astype(float) for v, w in zip(values, wide.tolist(), strict=True)])
        size_ = padded_size(d)
        hashes, last, tables = plans[size_]
        kind = np.uint8 if 2 * size_ < 255 else np.uint16 if 2 * size_ < 65535 else np.uint32
        cells = np.frombuffer(b"".join(b.column("cells").take(pa.array(at)).to_pylist()), kind).reshape(len(at), tables, hashes + (last > 0), AXES)
        group = np.stack([bucket[at], low[at].astype(np.int64) << 32 | high[at]], axis=1)
        yield d, _Rows(
            group=group.view("i8,i8").reshape(-1), split=low[at] != high[at], node=node, own=own[at], size=size[at], block=block[at], table=(bucket[at] >> 48).astype(int), cells=cells, vector=vector,
        )


def _merged(rows: _Rows) -> _Rows:
    """Rows of one node in one group as one, which lives there if one of them does."""
    first = np.r_[True, (rows.group[1:] != rows.group[:-1]) | (rows.node[1:] != rows.node[:-1]).any(axis=1)]
    if first.all():
        return rows
    out = rows.part(first)
    out.own = np.logical_or.reduceat(rows.own, np.flatnonzero(first))
    return out


def link_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths don't link.  Repeated rows are rows of their own: each links with
    the other.  Null ids: as in ``near_duplicates``.  Other columns are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, value, dims = [], [], []
            for v in b.column(1).to_pylist():
                x = np.array(v, float) + 0.0 if v and None not in v else np.zeros(1)
                good = bool(np.isfinite(x).all() and x.any())
                digest.append(xxhash.xxh3_128_digest(x.tobytes()) if good else None)
                with np.errstate(over="ignore"):
                    narrow = x.astype("<f4")
                value.append((narrow if (narrow == x).all() else x).tobytes() if good else None)
                dims.append(len(x) if good else None)
            yield pa.record_batch([b.column(0), pa.array(digest, pa.binary()), pa.array(value, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "digest", "value", "dims"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    # a value of single precision is kept as such where nothing is lost
    rows = staged(rows.mapInArrow(read, "vec_id long, digest binary, value binary, dims int"), "vectors")
    firsts = (F.min("vec_id").alias("least_id"), F.count("*").alias("size"), F.first("value").alias("value"), F.first("dims").alias("dims"))
    nodes = rows.where("digest IS NOT NULL").groupBy("digest").agg(*firsts)
    nodes = staged(nodes.withColumn("node", name_column(F.col("least_id"), F.col("digest"))), "vector-nodes")
    counts: dict[int, int] = {}
    for r in nodes.groupBy(F.ceil(F.log2(F.col("dims"))).alias("bits")).agg(F.count("*").alias("n")).collect():
        counts[1 << max(1, r.bits)] = counts.get(1 << max(1, r.bits), 0) + r.n
    plans = {size: plan(n, size, cosine) for size, n in counts.items()}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                dims, values = part.column("dims").to_numpy(), part.column("value").to_pylist()
                width = np.array([len(v) for v in values]) // dims
                codes: list = [None] * len(values)
                cells: list = [None] * len(values)
                for d in np.unique(dims).tolist():
                    members = np.flatnonzero(dims == d).tolist()
                    x = np.stack([np.frombuffer(values[k], f"<f{width[k]}").astype(float) for k in members])
                    # scaled, so very large components don't overflow
                    c = cross_polytope(x / np.abs(x).max(axis=1, keepdims=True), *plans[padded_size(d)])
                    for k, own, near in zip(members, bucket_codes(c, d), c, strict=True):
                        codes[k], cells[k] = own.reshape(-1), near.tobytes()
                lens = np.concatenate([[0], np.cumsum([c.size for c in codes])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(codes), pa.int64()))
                names = ["node", "codes", "cells", "value", "width", "dims", "size"]
                yield pa.record_batch([part.column("node"), lists, pa.array(cells, pa.binary()), part.column("value"), pa.array(width, pa.int32()), part.column("dims"), part.column("size")], names)

    # buckets of each node: position 0 of a table's codes is where it lives
    schema = "node binary, codes array<long>, cells binary, value binary, width int, dims int, size long"
    coded = staged(nodes.select("node", "value", "dims", "size").mapInArrow(hashed, schema), "vector-codes")
    tables = F.shiftright(F.element_at("codes", -1), 48) + 1
    looks = coded.select("node", "codes", (F.size("codes") / tables).cast("int").alias("each")).select("node", "each", F.posexplode("codes").alias("p", "bucket"))
    looks = looks.select("node", "bucket", (F.col("p") % F.col("each") == 0).alias("own"))
    sizes = looks.groupBy("bucket").agg(F.count("*").alias("c"), F.max("own").alias("lived"))
    useful = sizes.where("c > 1 AND lived").select("bucket", F.ceil(F.col("c") / BLOCK).cast("int").alias("k"))
    looks = looks.join(useful, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("k")).cast("int"))
    looks = looks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    looks = looks.select("node", "bucket", "own", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = looks.join(coded.drop("codes"), "node").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: Rows of each number of dimensions whose last group may go on in the next batch.
        held: dict[int, _Rows] = {}

        def given(links: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*links, strict=True), kinds, strict=True)], ["node", "weight", "root"])

        for b in batches:
            for d, new in _dealt_rows(b, plans):
                every = _Rows.joined([held[d], new] if d in held else [new])
                last = int(np.flatnonzero(np.r_[True, every.group[1:] != every.group[:-1]])[-1])
                held[d] = every.part(slice(last, None))
                if last and (links := _links(_merged(every.part(slice(0, last))), cosine)):
                    yield given(links)
        for rest in held.values():
            if links := _links(_merged(rest), cosine):
                yield given(links)

    links = staged(dealt.mapInArrow(linked, "node binary, weight long, root binary"), "vector-links")
    found = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    weights = links.groupBy("node").agg(F.sum("weight").alias("weight"))
    named = nodes.select("node", "digest", "size").join(found, "node", "left").join(weights, "node", "left")
    n_links = F.coalesce("weight", F.lit(0)) + F.col("size") - 1
    by_digest = named.select("digest", n_links.alias("n_links"), id_of(F.coalesce("root", "node")).alias("component_id"))
    out = rows.select("vec_id", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
