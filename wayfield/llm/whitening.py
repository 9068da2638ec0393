"""Whitening of embeddings: principal components of exactly centred vectors, each scaled to variance one.

Components become x = floor(scale * c) + shift, whole numbers.  Their sums S over all n rows are exact, n * x - S is an exact whole number too, and a row of the
matrix is that over n: rounded once, after centring.  Spark MLlib's RowMatrix multiplies the rows (computeGramianMatrix over n is the covariance V); numpy's eigh
takes V apart on the driver, and the eigenvectors over the roots of their eigenvalues are broadcast and applied in mapInPandas.

How it scales.  One pass for the sums (64 numbers a task), one for the product (a dimension * dimension matrix a task, added up as a tree), one that whitens and is staged;
what reaches the driver depends on the dimension alone.  No row is shuffled.  The check of the result, the whitened rows' own covariance, is a second
RowMatrix of `components` columns.

Nulls and odd cases: vectors that are null, empty, or hold null or non-finite components are left out, as are those of another length than most; components beyond
2**20 stop the query, as sums would leave 64 bits; components without variance (fewer independent rows than components, all rows equal, one
row) cannot be scaled to one and give no rows; equal eigenvalues have any orthogonal axes; a null vec_id is kept; repeated rows count as often as they occur;
other columns are not read, so no name can clash; an empty table gives no rows.  ``deviation`` is exact (decimal); it outgrows 64 bits at some millions of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import finite_vectors, stage


def gramian(rows: DataFrame, column: Column, size: int) -> np.ndarray:
    """The sum of the outer products of an array column with itself."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, 0, size).computeGramianMatrix().toArray()


def axes(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a covariance, `most` at most, without those that are zero to its precision."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    there = e > 16 * len(e) * np.finfo(float).eps * max(e[0], 0)
    return e[there][:most], u[:, there][:, :most]


def deviation(y: Column, fits: bool) -> Column:
    """The sum of squares of whole numbers, in 64 bits where they fit."""
    kind = "long" if fits else "decimal(38,0)"
    square = lambda s, a: (s + (a.cast("long") * a.cast("long") if fits else a.cast("decimal(19,0)") * a.cast("decimal(19,0)"))).cast(kind)
    return F.aggregate(y, F.lit(0).cast(kind), square).cast("decimal(38,0)")


def whitened(vectors: DataFrame, column: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> tuple[DataFrame, dict]:
    """vec_id, deviation and w (array of whitened components) of each row; and n, explained (a share for each component) and identity_error of the whole."""
    whole = F.transform("v", lambda c: F.floor(F.lit(float(scale)) * c).cast("long") + shift)
    rows = stage(finite_vectors(vectors, column, 2.0**20, "vec_id").select("vec_id", whole.alias("x")))
    sums = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()  # one for each dimension
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation decimal(38,0), w array<double>"
    if not sums:
        return vectors.sparkSession.createDataFrame([], schema), {"n": 0, "explained": [], "identity_error": 0.0}
    n = sums[0].n
    fits = sum(max(n * r.hi - r.s, r.s - n * r.lo) ** 2 for r in sums) < 1 << 63
    exact = F.zip_with("x", F.array(*[F.lit(r.s).cast("long") for r in sums]), lambda x, s: F.lit(n).cast("long") * x - s)
    centred = rows.withColumn("y", exact)
    real = F.transform("y", lambda y: y.cast("double") / F.lit(float(n)))
    v = gramian(centred, real, len(sums)) / n
    e, u = axes(v, components)
    if not len(e):
        return vectors.sparkSession.createDataFrame([], schema), {"n": n, "explained": [], "identity_error": 0.0}
    shared = vectors.sparkSession.sparkContext.broadcast(u / np.sqrt(e))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            w = np.stack(f["y"].to_numpy()) @ shared.value if len(f) else np.zeros((0, 1))
            yield pd.DataFrame({"vec_id": f["vec_id"], "deviation": f["deviation"], "w": list(w)})

    out = stage(centred.select("vec_id", deviation(F.col("y"), fits).alias("deviation"), real.alias("y")).mapInPandas(run, schema))
    means = out.agg(F.array(*[F.avg(F.col("w")[i]) for i in range(len(e))])).first()[0]
    covariance = gramian(out, F.zip_with("w", F.array(*map(F.lit, means)), lambda a, m: a - m), len(e)) / n
    return out, {"n": n, "explained": (e / np.trace(v)).tolist(), "identity_error": float(np.abs(covariance - np.eye(len(e))).max())}


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each row and component; deviation_exact besides, as deviation is null beyond 64 bits."""
    out, about = whitened(vectors, column, components)
    explained = F.array(*map(F.lit, about["explained"])) if about["explained"] else F.array().cast("array<double>")
    rows = out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(about["n"]).cast("long").alias("n"), F.expr("try_cast(deviation AS long)").alias("deviation"),
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(about["identity_error"]).alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )
