"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find.

A document's set holds its distinct five-word shingles (64-bit hashes of them; two different
shingles of two documents fall together with a chance of about 2**-64 a pair).  Documents with equal
sets form a class and go on as one node, named by its least id and a 128-bit fingerprint of the set, so
the smallest node of a component holds the component's id.

SuperMinHash draws, for each element, a random permutation of the slots step by step (Fisher-Yates)
with rank + uniform as the value, so an element's ranks differ between slots.  Levels run over all
elements of a batch at once and stop for a document as soon as no later rank can lower a slot.

Links are sought in two turns over the buckets of equal bands.  First every member is compared with
the leader of its bucket, and of each narrower bucket (several equal bands in a row) within it: the
member that shares the most buckets' company.  That is a fixed number of rows per member.  Then, in
buckets that still hold more than one component, members outside the largest one are compared with
all members of other components whose size and signature allow the similarity.  A pair within one
component adds nothing, so no pair of a bucket that could join two components is left out, and
groups of copies cost a row per copy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import fresh, staged
from veilspan.llm.components import components, id_of, name_column, name_of

#: A pair of similarity 0.75 misses all bands with a chance of (1 - 0.75**4)**32 = 5e-6.
SHINGLE_WORDS, PERCENT, BANDS, ROWS = 5, 75, 32, 4
SLOTS = BANDS * ROWS
#: Bands in a row whose equality makes a narrower bucket, for leaders among closer members.
NARROW = (2, 4, 8)
#: Of equal slots, at least, to verify a pair of the second turn: 0.75 less five standard deviations.
LEAST_EQUAL = int(SLOTS * (0.75 - 5 * (0.75 * 0.25 / SLOTS) ** 0.5))

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _steps(n: int) -> np.uint64:
    return _U(n * int(_STEP) & (1 << 64) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FACTOR = _mix(np.arange(1, 65, dtype=_U) * _STEP) | _U(1)


def shingle_set(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words, of the whole sequence; else empty."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, _U)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    if len(w) < size:
        return _mix((w * _FACTOR[: len(w)]).sum(dtype=_U, keepdims=True) + _steps(len(w)))
    h = np.zeros(len(w) - size + 1, _U)
    for i in range(size):
        h += w[i : len(w) - size + 1 + i] * _FACTOR[i]
    return np.unique(_mix(h))


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (documents by slots); the high 32 bits of a value are its rank.  An empty set keeps
    the largest value in every slot."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), slots), ~_U(0), _U)
    flat = out.reshape(-1)
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
    base = np.repeat(np.arange(len(sets)) * slots, sizes)
    places = None
    for level in range(slots):
        if not len(elements):
            break
        r = _mix(elements + _steps(level + 1))
        k = (level + (((r & _U(0xFFFFFFFF)) * _U(slots - level)) >> _U(32)).astype(np.int64)).astype(np.int64)
        if level == 0:
            slot, first = k, k
        else:
            row = np.arange(len(elements))
            slot = places[row, k].astype(np.int64)
            places[row, k] = places[:, level]
        np.minimum.at(flat, base + slot, (_U(level) << _U(32)) | (r >> _U(32)))
        going = out.max(axis=1) >= (_U(level + 1) << _U(32))
        stay = going[base // slots]
        elements, base = elements[stay], base[stay]
        if level == 0:  # permutations are kept from here on, for the documents that go on
            first = first[stay]
            places = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
            places[np.arange(len(elements)), first] = 0
        else:
            places = places[stay]
    return out


def bands_of(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit hash for each band, with the band's number in it."""
    s = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    return _mix((s * _FACTOR[:rows]).sum(axis=2, dtype=_U) + _mix(np.arange(1, bands + 1, dtype=_U) * _STEP))


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1), kind))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, digest (fingerprint; null without words), bands, signature and key of every row."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            while at < b.num_rows:
                sets, held = [], 0
                start = at
                while at < b.num_rows and held < 40_000:
                    sets.append(shingle_set(b.column(1)[at].as_py()))
                    held += len(sets[-1]) + 1
                    at += 1
                signatures = super_minhash(sets)
                nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                folded = (signatures ^ (signatures >> _U(32))).astype(np.uint32).view(np.int32)
                yield pa.record_batch(
                    [b.column(0).slice(start, at - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), _lists(bands_of(signatures).view(np.int64), pa.int64()), _lists(folded, pa.int32()), b.column(2).slice(start, at - start)],
                    ["doc_id", "n_shingles", "digest", "bands", "signature", "key"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(None) if key is None else key).cast("binary").alias("key"))
    return rows.mapInArrow(sketched, "doc_id long, n_shingles long, digest binary, bands array<long>, signature array<int>, key binary")


def _full_sets(docs: DataFrame, nodes: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, elements) of the nodes in ``names``, from the whole texts of documents that stand for them."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [(i, shingle_set(t.as_py())) for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                found = [(i, s) for i, s in found if len(s)]
                names = [name_of(i, xxhash.xxh3_128_digest(s.tobytes())) for i, s in found]
                yield pa.record_batch([pa.array(names, pa.binary()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], ["node", "elements"])

    wanted = nodes.select("node", F.col("least_id").alias("wanted")).join(names, "node", "left_semi").select("wanted").distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("text"))
    rows = rows.join(wanted, rows["i"].eqNullSafe(wanted["wanted"]), "left_semi").select("i", "text")
    return staged(rows.mapInArrow(sets, "node binary, elements array<long>").dropDuplicates(["node"]), "full-sets")


def _in_a_row(ring: Column, width: int) -> Callable[[Column], Column]:
    return lambda k: F.xxhash64(F.slice(ring, k, F.lit(width)), k, F.lit(width))


def _similar(a: str, b: str, percent: int) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common * 100 >= (F.size(a) + F.size(b) - common) * percent


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Null and empty texts, and texts of white space, have an empty set and link with nothing; a text
    of fewer than five words is one shingle.  Repeated rows (equal ids) each get their row; both are
    kept if their id is the component's.  A null id never names a component that holds another id;
    a component of null ids alone has a null id, and its rows are kept.  Other columns are ignored.
    """
    rows, named = _rooted(docs, id_col, text_col, percent)
    by_digest = named.select("digest", id_of(F.col("root")).alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with exactly one row of each group of near duplicates: that with the smallest id, a null
    id only where the group has no other; rows outside groups, without words too, all stay.

    Rows are told apart by id and whole text (a 128-bit hash of both), so null and repeated ids decide
    nothing about other rows; of rows equal in both, any one stands for all.
    """
    name = fresh("key", docs.columns)
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text_col, F.lit("")))))
    _, named = _rooted(docs, id_col, text_col, percent, key)
    chosen = named.where("node = root").select(F.col("least.key").alias(name))
    keyed = docs.withColumn(name, key)
    words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # copies of a row are merged before the shuffle
    return keyed.where(words).dropDuplicates([name]).join(chosen, name, "left_semi").unionByName(keyed.where(~words)).drop(name)


def _rooted(docs: DataFrame, id_col: str, text_col: str, percent: int, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and of every node: its digest, its component's root and, of its rows, the
    least (id is null, id, key)."""
    rows = staged(sketch(docs, id_col, text_col, key), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key"))
    firsts = [F.first(c).alias(k) for c, k in (("n_shingles", "n"), ("bands", "bands"), ("signature", "signature"))]
    nodes = rows.where("digest IS NOT NULL").groupBy("digest").agg(least.alias("least"), *firsts).withColumn("least_id", F.col("least.doc_id"))
    nodes = staged(nodes.withColumn("node", name_column(F.col("least_id"), F.col("digest"))), "nodes")

    # members of buckets with company, and how much company each member has in all
    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    company = buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    members = staged(buckets.join(company, "bucket"), "members")
    crowd = members.groupBy("node").agg(F.sum("c").alias("s"))
    # the same members in narrower buckets, of two bands and more in a row
    narrow = nodes.join(crowd, "node").select("node", "n", "s", "bands")
    ring = F.concat("bands", "bands")
    joined = [F.transform(F.sequence(F.lit(1), F.lit(BANDS)), _in_a_row(ring, width)) for width in NARROW]
    narrow = narrow.select("node", "n", "s", F.explode(F.concat(*joined)).alias("bucket")).unionByName(members.join(crowd, "node").select("node", "n", "s", "bucket"))
    narrow = staged(narrow, "ranked")
    leaders = narrow.groupBy("bucket").agg(F.max(F.struct("s", "node", "n")).alias("l"), F.count("*").alias("c")).where("c > 1").select("bucket", F.col("l.node").alias("leader"), F.col("l.n").alias("leader_n"))
    fits = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent
    pairs = narrow.join(leaders, "bucket").where((F.col("node") != F.col("leader")) & fits).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    pairs = staged(pairs, "leader-pairs")
    links = _verified(docs, nodes, pairs, percent, id_col, text_col)
    found = components(links)

    # buckets that still hold several components
    placed = members.join(found, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    shares = placed.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("bucket").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count("*").alias("k")).where("k > 1").select("bucket", "main")
    mixed = staged(placed.join(mixed, "bucket").join(nodes.select("node", "signature", "bands"), "node"), "mixed-buckets")
    fields = ("node", "n", "root", "signature", "bands")
    x = mixed.where("root <> main").select("bucket", *[F.col(c).alias(f"x_{c}") for c in fields])
    y = mixed.select("bucket", "main", *[F.col(c).alias(f"y_{c}") for c in fields])
    equal = F.aggregate(F.zip_with("x_signature", "y_signature", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    # of all buckets that a pair shares, the first brings it up
    first = F.element_at(F.filter(F.zip_with("x_bands", "y_bands", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull()), 1)
    may_link = (
        (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x_root") != F.col("y_root"))
        & ((F.col("y_root") == F.col("main")) | (F.col("x_node") < F.col("y_node")))
        & (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent)
        & (first == F.col("x.bucket"))
        & (equal >= LEAST_EQUAL)
    )
    # members with a partner of that kind, at most a row each; then their links, compared on full
    # sets within the join, which gives links alone and no row for a pair that is none
    x, y = x.alias("x"), y.alias("y")
    x, y = staged(x.join(y, may_link, "left_semi"), "rest-x"), staged(y.join(x, may_link, "left_semi"), "rest-y")
    if not x.isEmpty():
        names = x.select(F.col("x_node").alias("node")).unionByName(y.select(F.col("y_node").alias("node"))).distinct()
        sets = _full_sets(docs, nodes, names, id_col, text_col)
        x = x.join(sets.select(F.col("node").alias("x_node"), F.col("elements").alias("x_elements")), "x_node").alias("x")
        y = y.join(sets.select(F.col("node").alias("y_node"), F.col("elements").alias("y_elements")), "y_node").alias("y")
        more = x.join(y, may_link & _similar("x_elements", "y_elements", percent)).select(F.col("x_node").alias("a"), F.col("y_node").alias("b"))
        more = staged(more, "rest-links")
        found = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    return rows, nodes.select("node", "digest", "least").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Of candidate pairs of nodes, those whose full sets are similar enough."""
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _full_sets(docs, nodes, both, id_col, text_col)
    a, b = (sets.select(F.col("node").alias(c), F.col("elements").alias(f"{c}_elements")) for c in "ab")
    return staged(pairs.join(a, "a").join(b, "b").where(_similar("a_elements", "b_elements", percent)).select("a", "b"), "links")
