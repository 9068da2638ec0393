"""Approximate nearest neighbours by additive quantisation, then exact reranking.

A unit vector is stored as a sum of one full-dimensional codeword from each of ``books`` codebooks, which
beam search picks, and the norm of that sum.  A query makes one table for each codebook, its products
with the codewords; a row's score is the sum of its entries over the stored norm.  The best rows by
that score in each run of 1000 rows of the index get their exact cosine from the original vectors, and only
the nearest of each task go on.

How it scales.  The codebooks are fitted on a bounded sample (``sample`` rows, the first by a hash of the
vector); every row is encoded and staged in files of about ``block`` rows.  Queries go out in broadcast groups of
about ``group``, a bound at any size of input, each with one pass over the index; ``keep`` rows are
reranked for each query and run, whatever the Arrow batches are, so recall doesn't fall as the index grows.  Of each task and
query, ``k`` rows are shuffled.

Nulls and odd cases: vectors that are null, of another length than most, zero, or that hold null or non-finite
components take no part, as queries or candidates; equal vectors have equal codes and scores, and ties
go to the smaller vec_id at each step; repeated vec_ids are rows of their own, and only the query's own
row is no candidate; very long vectors are read like any other; columns other than vec_id and the vector are not read, so their names cannot clash; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.float32) @ b.astype(np.float32).T


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centres; an empty one moves to a random row."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = (2 * _products(x, centres) - (centres * centres).sum(1)).argmax(1)
        n = np.bincount(at, minlength=k)
        for j in range(x.shape[1]):
            centres[:, j] = np.bincount(at, weights=x[:, j], minlength=k) / np.maximum(n, 1)
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


@dataclass
class Quantiser:
    books: np.ndarray  # book, codeword, dimension

    def encode(self, x: np.ndarray, beam: int = 4, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Codes and norms of the sums: of all sums, the `beam` nearest so far are carried from book to book."""
        codes, norms = [], []
        for i in range(0, len(x), chunk):
            rest, paths = x[i : i + chunk, None, :].astype(np.float32), np.zeros((len(x[i : i + chunk]), 1, 0), np.uint8)
            for book in self.books.astype(np.float32):
                n, b, d = rest.shape
                error = (rest * rest).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, b, -1) + (book * book).sum(1)
                flat = error.reshape(n, -1)
                keep = min(beam, flat.shape[1])
                best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
                parent, word = best // len(book), best % len(book)
                rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
                paths = np.concatenate([np.take_along_axis(paths, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            least = (rest * rest).sum(2).argmin(1)
            codes.append(paths[np.arange(len(paths)), least])
            norms.append(np.linalg.norm(self.decode(codes[-1]), axis=1))
        return (np.concatenate(codes), np.concatenate(norms)) if codes else (np.zeros((0, len(self.books)), np.uint8), np.zeros(0))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))


def fit(x: np.ndarray, books: int, words: int = 256, rounds: int = 6, seed: int = 5) -> Quantiser:
    """Residual k-means gives the books; beam search, not these first assignments, encodes the rows."""
    rng, rest, found = np.random.default_rng(seed), x.astype(np.float64), []
    for _ in range(books):
        found.append(kmeans(rest, words, rounds, rng))
        rest = rest - found[-1][(2 * _products(rest, found[-1]) - (found[-1] ** 2).sum(1)).argmax(1)]
    return Quantiser(np.array(found))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300) / np.linalg.norm(x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300), axis=1, keepdims=True)


def _cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In double precision, the products and sums over the original components."""
    return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Positions of the n highest; of equal ones the first."""
    if len(scores) <= n:
        return np.arange(len(scores))
    edge = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: n - len(above)]])


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """uid, vec_id and v (doubles) of the rows that take part."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("vec_id").isNotNull()
    )
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size.n if size else 0)).select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v")


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of exactly `rows`, but for the last."""
    held: list = []
    for batch in batches:
        held.append(batch)
        while sum(map(len, held)) >= rows:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield whole.slice(0, rows)
            held = [whole.slice(rows)] if len(whole) > rows else []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _searcher(model, held, k: int, keep: int, run: int = 1000):
    """The nearest rows of a task's part of the index: `keep` of each `run` rows are reranked, k of all go on."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, ids, queries = held.value
        books = model.value.books
        tables = np.stack([_unit(queries) @ book.T for book in books], 1)  # query, book, codeword
        best: list = [None] * len(queries)
        for batch in _runs(batches, run):
            batch = batch.take(pa.compute.sort_indices(batch.select(["vec_id", "uid"]), sort_keys=[("vec_id", "ascending"), ("uid", "ascending")]))
            own, vec, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(x), -1)
            norms = np.maximum(batch.column(4).to_numpy(), 1e-12)
            for q in range(len(queries)):
                scores = tables[q][np.arange(len(books)), codes].sum(1) / norms
                at = _best(scores, keep + 1)
                at = at[own[at] != uids[q]]
                found = (-_cosines(queries[q], x[at]), vec[at], own[at])
                if best[q] is not None:
                    found = tuple(np.concatenate(z) for z in zip(best[q], found, strict=True))
                order = np.lexsort(found[::-1])[:k]
                best[q] = tuple(z[order] for z in found)
        for q, found in enumerate(best):
            if found is not None:
                yield pa.record_batch({"query_uid": np.full(len(found[0]), uids[q]), "query_id": np.full(len(found[0]), ids[q]), "uid": found[2], "vec_id": found[1], "score": -found[0]})

    return search


def nearest(
    vectors: DataFrame, query_mod: int = 50, k: int = 5, books: int = 16, keep: int = 160, block: int = 8192, group: int = 2048, sample: int = 8192, beam: int = 4, column: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found for each row whose vec_id query_mod divides."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors, column))
    n = rows.count()
    first = rows.orderBy(F.xxhash64("v", "vec_id"), "uid").limit(sample).select("v").toPandas()["v"]
    empty = "query_uid long, query_id long, uid long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    model = spark.sparkContext.broadcast(fit(_unit(np.stack(first.to_numpy())), books))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, norms = model.value.encode(_unit(_matrix(batch.column(2))), beam)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float64))], ["uid", "vec_id", "v", "codes", "norm"])

    index = stage(rows.repartition(-(-n // block)).mapInArrow(encode, "uid long, vec_id long, v array<double>, codes binary, norm double"))
    asked = rows.where(F.col("vec_id") % query_mod == 0)
    groups = max(1, -(-asked.count() // group))
    parts = []
    for g in range(groups):
        mine = asked.where(F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(groups)) == g).orderBy("vec_id", "uid").toPandas()  # about `group` rows
        if not len(mine):
            continue
        held = (mine["uid"].to_numpy(np.int64), mine["vec_id"].to_numpy(np.int64), np.stack(mine["v"].to_numpy()))
        parts.append(stage(index.mapInArrow(_searcher(model, spark.sparkContext.broadcast(held), k, keep), empty)))
    if not parts:
        return spark.createDataFrame([], empty).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
