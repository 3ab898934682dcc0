"""Whitening of embeddings with distributed block matrices.

Vectors become integers and get gapless indexes; the centred rows are blocks of
a BlockMatrix A, whose product with its own transpose is the scatter matrix.
Its eigenvectors are found on the driver (dims x dims numbers), and A times
the whitening matrix is the projection of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equilens.llm.centroids import finite
from equilens.llm.common import written

#: Rows of a block: at least, and at most. The driver sees the number of every block, so there are fewer of them as tables grow.
BLOCK_ROWS = (1024, 16_384)
#: Blocks that one task of a product adds up.
TOGETHER = 8
#: Columns of a block, at most.
BLOCK_COLUMNS = 1024
#: Share of the trace below which an eigenvalue is rounding, so that its component has no scale.
NOTHING = 1e-13


@dataclass
class Whitened:
    """`rows` has (key, index, deviation), `projected` (index, w), both in the shared folder; `explained` is by component."""

    rows: DataFrame
    projected: DataFrame
    n: int
    explained: list[float]
    identity_error: float


def indexed(vectors: DataFrame, key: str, vector: str, scale: float, offset: int) -> tuple[DataFrame, int, int]:
    """(id, x, index) of the rows that remain, in the shared folder, with their number and the vectors' length.

    Every partition numbers its own rows as they are written; the driver gets a
    count for each partition, and no row is moved.
    """
    cells = F.col(vector).cast("array<double>")
    whole = vectors.where(finite(F.col(vector))).select(F.col(key).alias("id"), F.transform(cells, lambda c: F.floor(F.lit(scale) * c).cast("long") + F.lit(offset)).alias("x"))
    place = {"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)), "dims": F.size("x")}
    rows = written(whole.withColumns(place), "vectors")
    lengths = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths.dims if lengths else 0
    if not dims:
        return rows.select("id", "x", F.col("place").alias("index")).limit(0), 0, 0
    counts = rows.where(F.col("dims") == dims).groupBy("part").agg(F.count("*").alias("n"), (F.max("place") + 1).alias("upto")).orderBy("part").collect()
    if any(r.n != r.upto for r in counts):  # vectors of another length leave gaps
        rows = written(rows.where(F.col("dims") == dims).select("id", "x", "dims", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("place")), "vectors")
        counts = rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    first = np.cumsum([0, *(r.n for r in counts)]).tolist()
    starts = vectors.sparkSession.createDataFrame([(r.part, s) for r, s in zip(counts, first)], "part int, start long")  # a row for each partition
    found = rows.where(F.col("dims") == dims).join(F.broadcast(starts), "part")
    return found.select("id", "x", (F.col("start") + F.col("place")).alias("index")), first[-1], dims


def block_matrix(rows: DataFrame, cells: Column, n: int, dims: int) -> BlockMatrix:
    """`cells` (array<double>) of the rows by their `index`; blocks are gathered by a shuffle, each bounded."""
    most = max(BLOCK_ROWS[0], min(BLOCK_ROWS[1], n // 50_000))
    vectors = rows.select("index", array_to_vector(cells).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dims).toBlockMatrix(most, min(dims, BLOCK_COLUMNS))


def scatter(a: BlockMatrix) -> np.ndarray:
    """The transpose of `a` times `a`, on the driver (columns x columns).

    The rows are the inner dimension of the product. It is cut into splits of
    TOGETHER blocks, whose products are added up, as else one task would get
    all rows; this form of multiply has no wrapper in Python.
    """
    blocks = -(-a.numRows() // a.rowsPerBlock)
    splits = max(1, -(-blocks // TOGETHER))
    left = a.transpose()._java_matrix_wrapper
    product = left.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def times(a: BlockMatrix, matrix: np.ndarray, spark: SparkSession) -> BlockMatrix:
    """`a` times a small local matrix."""
    cells = spark.createDataFrame([(i, row) for i, row in enumerate(matrix.tolist())], "index long, w array<double>")
    vectors = MLUtils.convertVectorColumnsFromML(cells.select("index", array_to_vector("w").alias("vector")), "vector")
    right = IndexedRowMatrix(vectors, *matrix.shape).toBlockMatrix(a.colsPerBlock, min(matrix.shape[1], BLOCK_COLUMNS))
    return a.multiply(right)


def rows_of(a: BlockMatrix) -> DataFrame:
    """(index, w): the rows of `a`, without a detour over Python."""
    rows = callMLlibFunc("getIndexedRows", a.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("w"))


def _sums(rows: DataFrame, dims: int) -> list[int]:
    """Exact sums of the vectors by dimension: a row for each batch is shuffled."""
    exact = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, dims)
                wide = int(np.abs(x).max()) * b.num_rows >= 2**63
                sums = (x.astype(object) if wide else x).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array([[Decimal(int(s)) for s in sums]], pa.list_(exact))], ["s"])

    parts = rows.select("x").mapInArrow(run, "s array<decimal(38,0)>")
    return [int(s) for s in parts.agg(*(F.sum(F.col("s")[i]) for i in range(dims))).first()]


def _released(*matrices: BlockMatrix) -> None:
    for m in matrices:
        m._java_matrix_wrapper._java_model.blocks().unpersist(False)


def _centred(cells: Column, sums: list[int], n: int) -> Column:
    return F.zip_with(cells, F.array(*map(F.lit, sums)), lambda x, s: F.lit(n) * x - s)


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32, scale: float = 64.0, offset: int = 1_000_000) -> Whitened | None:
    """Whitens the integers floor(scale * c) + offset of all vectors.

    Null vectors and those with an entry that is null or no number are dropped,
    and so are those of another length than most (of equally frequent lengths
    the longer one counts). Repeated rows and null keys are rows like others.
    Without rows the result is None. Components whose eigenvalue is rounding
    (equal rows, fewer rows than dimensions, constant dimensions) have no scale
    and are left out. Exact deviations beyond a long fail under ANSI mode, the
    default. Blocks are kept in memory or on disk while they are used, and are
    made again where an executor is lost.
    """
    spark = vectors.sparkSession
    rows, n, dims = indexed(vectors, key, vector, scale, offset)
    if not n:
        return None
    sums = _sums(rows, dims)
    apart = _centred(F.col("x"), sums, n)
    a = block_matrix(rows, F.transform(apart, lambda d: d.cast("double") / F.lit(float(n))), n, dims).persist(StorageLevel.MEMORY_AND_DISK)
    covariance = scatter(a) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(np.trace(covariance))
    scaled = int((values[:components] > NOTHING * trace).sum()) if trace > 0 else 0
    kept = rows.select(F.col("id").alias(key), "index", F.aggregate(F.transform(apart, lambda d: d * d), F.lit(0).cast("long"), lambda s, d: s + d).alias("deviation"))
    if not scaled:
        _released(a)
        return Whitened(kept, spark.createDataFrame([], "index long, w array<double>"), n, [], 0.0)
    p = times(a, axes[:, :scaled] / np.sqrt(values[:scaled]), spark).persist(StorageLevel.MEMORY_AND_DISK)
    error = float(np.abs(scatter(p) / n - np.eye(scaled)).max())  # rows of p are centred, as those of a are
    projected = written(rows_of(p), "projected")
    _released(a, p)
    return Whitened(kept, projected, n, [float(v) / trace for v in values[:scaled]], error)


def components_of(whitened: Whitened) -> DataFrame:
    """The columns of `rows`, and component (from 1), whitened, explained: a row for each row and component.

    Rows and projections meet by a shuffle on the index, which no two rows share.
    """
    explained = F.array(*map(F.lit, whitened.explained)) if whitened.explained else F.array().cast("array<double>")
    met = whitened.rows.join(whitened.projected, "index").drop("index")
    long = met.select(*(c for c in met.columns if c != "w"), F.posexplode("w").alias("_at", "whitened"))
    return long.withColumn("component", F.col("_at") + 1).withColumn("explained", explained[F.col("_at")]).drop("_at")
