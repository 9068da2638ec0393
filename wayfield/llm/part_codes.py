"""Codes of vectors by parts (product quantisation) in whole numbers, with nearest entries found in kd-trees.

Components become floor(scale * x), vectors are cut into `parts` equal consecutive parts (the last ones one component shorter where the length leaves a rest), and
each part position has a codebook.  A round broadcasts one kd-tree for each codebook, finds every part's nearest entry and moves each entry to the floor of its
parts' mean.  A tree's node knows the box around its entries; the search goes to the nearer child first, then to the other one if its box is
*not farther* than the best entry so far, so an entry as near as the best but with a lower index is always seen, and it wins.  The search takes a whole batch
through the tree at once, with those rows alone that a node may hold something for.

How it scales.  The whole numbers are staged once; a round is one pass over them without a shuffle of rows: each task sends a count and integer
sums for each entry, and the totals (parts * entries rows) come to the driver.  All arithmetic is in integers, so neither the order of rows nor the number of tasks
changes a result.  Errors of equal labels are summed up in a group-by; rows meet their label's sum by a broadcast where a label holds many rows.

Nulls and odd cases: vectors that are null, empty, or hold null or non-finite components are left out, as are those of another length than most; components
beyond 2**26 / scale stop the query, as squares would leave 64 bits; the first entries are those of the smallest vec_ids, null ones last, of repeated ones the
smaller vector; fewer rows than entries give fewer entries; equal entries go to the lower index; an unused entry stays; null labels are one
label; repeated rows are coded on their own; other columns are not read, so no name can clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite_vectors, hot_join, stage


@dataclass
class Node:
    """A box around some entries; a leaf holds them (ascending), another node has two children."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None
    children: tuple[Node, Node] | None = None

    def distance(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of points to the box."""
        off = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (off * off).sum(1)


def build(points: np.ndarray, entries: np.ndarray | None = None, leaf: int = 2) -> Node:
    """Cut at the middle entry of the widest component, down to leaves of `leaf` entries, or of any number of equal ones."""
    entries = np.arange(len(points)) if entries is None else entries
    mine = points[entries]
    node = Node(mine.min(0), mine.max(0))
    spread = node.high - node.low
    if len(entries) <= leaf or not spread.any():
        node.entries = entries
    else:
        order = entries[np.argsort(mine[:, spread.argmax()], kind="stable")]
        half = len(order) // 2
        node.children = (build(points, np.sort(order[:half]), leaf), build(points, np.sort(order[half:]), leaf))
    return node


def nearest(tree: Node, points: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each row's nearest point, the lower index on ties."""
    which, best = np.full(len(q), len(points)), np.full(len(q), np.iinfo(np.int64).max)

    def visit(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.children is None:
            off = q[rows, None, :] - points[node.entries]
            far = (off * off).sum(2)
            first = far.argmin(1)  # of equal ones the lowest index, as a leaf's entries ascend
            far, entry = far[np.arange(len(rows)), first], node.entries[first]
            better = (far < best[rows]) | ((far == best[rows]) & (entry < which[rows]))
            best[rows[better]], which[rows[better]] = far[better], entry[better]
            return
        one, two = (child.distance(q[rows]) for child in node.children)
        left = one <= two
        for near, far, mine, bound in ((*node.children, left, two), (*node.children[::-1], ~left, one)):
            visit(near, rows[mine])
            visit(far, rows[mine][bound[mine] <= best[rows[mine]]])  # equal bounds may hide a lower index

    visit(tree, np.arange(len(q)))
    return which, best


def cuts(length: int, parts: int) -> list[slice]:
    sizes = [length // parts + (i < length % parts) for i in range(parts)]
    return [slice(sum(sizes[:i]), sum(sizes[: i + 1])) for i in range(parts)]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _found(shared, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    trees, books = shared.value
    return [nearest(t, b, x[:, at]) for t, b, at in zip(trees, books, cuts(x.shape[1], len(books)), strict=True)]


def moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round over rows' x."""
    shared = rows.sparkSession.sparkContext.broadcast(([build(b) for b in books], books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0))
                for k, ((which, _), at) in enumerate(zip(_found(shared, x), cuts(x.shape[1], len(books)), strict=True)):
                    n[k] += np.bincount(which, minlength=len(books[k]))
                    member = (which[:, None] == np.arange(len(books[k]))).astype(np.float64)
                    sums[k] += (member.T @ x[:, at].astype(np.float64)).astype(np.int64)  # whole numbers below 2**53, so the product is exact
        flat = [(k, e, i, int(n[k][e]), int(s)) for k in range(len(books)) for e in np.flatnonzero(n[k]).tolist() for i, s in enumerate(sums[k][e])]
        part, entry, at, count, total = zip(*flat, strict=True) if flat else ([],) * 5
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()), pa.array(count, pa.int64()), pa.array(total, pa.decimal128(38, 0))], ["part", "entry", "at", "n", "s"])

    sent = rows.select("x").mapInArrow(run, "part int, entry int, at int, n long, s decimal(38,0)")
    out = [b.copy() for b in books]
    for r in sent.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # one for each component of an entry
        out[r.part][r.entry, r["at"]] = int(r.s) // r.n
    return out


def fitted(rows: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    x = np.array([r.x for r in first], np.int64)
    books = [x[:, at].copy() for at in cuts(x.shape[1], parts)]
    for _ in range(rounds):
        books = moved(rows, books)
    return books


def encode(vectors: DataFrame, column: str = "embedding", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (of all rows with the label) and codebooks_sha256 of vectors' vec_id, label and column."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    spark = vectors.sparkSession
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    whole = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("int"))
    rows = stage(finite_vectors(vectors, column, 2.0**26 / scale, "vec_id", "label").select("vec_id", "label", whole.alias("x")))
    if not rows.limit(1).count():
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    books = fitted(rows, parts, entries, rounds)
    shared = spark.sparkContext.broadcast(([build(b) for b in books], books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _found(shared, _matrix(batch.column(2))) if len(batch) else []
            code = np.stack([w.astype(np.uint8) for w, _ in found], 1) if found else np.zeros((0, parts), np.uint8)
            error = sum(d for _, d in found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    coded = rows.select("vec_id", "label", "x").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    coded = stage(coded.withColumn("k", F.coalesce(F.concat(F.lit("l"), F.col("label").cast("string")), F.lit("n"))))
    sums = stage(coded.groupBy("k").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("w_size")))
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    return hot_join(coded, sums, ["k"], "w_size", coded.count()).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
