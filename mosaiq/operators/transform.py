"""Block transform: 8x8 DCT, quantization and zig-zag, exact in integers.

``coded`` is the production form, one Arrow pass over whole batches. The relational
forms say the same in joins and sums; stacked array lambdas are avoided, as the
optimizer would inline one into the other and repeat its work for each element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import standard

COSINE = np.array(standard.COSINE, dtype=np.int64)


def forward(samples: np.ndarray) -> np.ndarray:
    """DCT of (n, 64) samples: both passes unrounded, one rounding away from zero at Q28, wrapped to 16 bits."""
    s = samples.reshape(-1, 8, 8).astype(np.int64)
    total = np.einsum("uy,nyx,vx->nuv", COSINE, s, COSINE, optimize=True)
    rounded = np.sign(total) * ((np.abs(total) + (1 << 27)) >> 28)
    return rounded.astype(np.int16).astype(np.int64).reshape(-1, 64)


def quantized(coefficients: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.sign(coefficients) * ((np.abs(coefficients) + table // 2) // table)


def coded_samples(samples: np.ndarray, component: np.ndarray, quality: np.ndarray, step: int = 8192) -> np.ndarray:
    """Zig-zag coefficients of (n, 64) samples, a bounded number of blocks at a time."""
    out = np.zeros((len(samples), 64), np.int32)
    for lo in range(0, len(samples), step):
        part = slice(lo, lo + step)
        tables, which = np.unique(np.stack([quality[part], component[part] > 0], axis=1), axis=0, return_inverse=True)
        table = np.array([standard.quant(int(q), not c) for q, c in tables], dtype=np.int64)[which.ravel()]
        out[part] = quantized(forward(samples[part]), table)[:, standard.ZIGZAG]
    return out


def coded(blocks: DataFrame) -> DataFrame:
    """Replace ``samples`` by ``coeffs``: transformed, quantized for ``quality`` and in zig-zag order."""
    keep = [c for c in blocks.columns if c != "samples"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not len(batch):
                continue
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            samples = cols["samples"].flatten().to_numpy().reshape(-1, 64)
            out = coded_samples(samples, cols["component"].to_numpy(), cols["quality"].to_numpy())
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * 64)
            yield pa.RecordBatch.from_arrays([cols[c] for c in keep] + [pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=[*keep, "coeffs"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*keep).schema) + ", coeffs array<int>"
    return blocks.select(*keep, "samples").mapInArrow(run, schema)


def cosines(spark: SparkSession) -> DataFrame:
    """(u, x, w): 64 rows."""
    return spark.createDataFrame([(u, x, w) for u, row in enumerate(standard.COSINE) for x, w in enumerate(row)], "u int, x int, w bigint")


def dct_relational(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, v) to (keys, pos, f): two joins with the cosine table and two sums."""
    table = F.broadcast(cosines(samples.sparkSession))  # 64 rows
    rows = samples.withColumns({"x": F.col("pos") % 8, "y": F.floor(F.col("pos") / 8).cast("int")})
    first = rows.join(table.withColumnRenamed("u", "vv"), "x").groupBy(*keys, "y", "vv").agg(F.sum(F.col("w") * F.col("v")).alias("p"))
    second = first.join(table.select(F.col("u"), F.col("x").alias("y"), "w"), "y").groupBy(*keys, "u", "vv").agg(F.sum(F.col("w") * F.col("p")).alias("t"))
    magnitude = F.shiftright(F.abs("t") + (1 << 27), 28)
    return second.select(*keys, (F.col("u") * 8 + F.col("vv")).cast("int").alias("pos"), F.when(F.col("t") < 0, -magnitude).otherwise(magnitude).alias("f"))


def quant_tables(spark: SparkSession, qualities: list[int]) -> DataFrame:
    """(quality, luma, pos, zigzag, q) of both tables."""
    order = {p: k for k, p in enumerate(standard.ZIGZAG)}
    rows = [(q, l, p, order[p], standard.quant(q, l)[p]) for q in qualities for l in (True, False) for p in range(64)]
    return spark.createDataFrame(rows, "quality int, luma boolean, pos int, zigzag int, q int")


def quantized_relational(coefficients: DataFrame, tables: DataFrame) -> DataFrame:
    """(keys, quality, luma, pos, f) to the quantized value ``c`` at its zig-zag place."""
    joined = coefficients.join(F.broadcast(tables), ["quality", "luma", "pos"])  # 128 rows for each quality used
    magnitude = F.expr("(abs(f) + (q div 2)) div q")
    return joined.withColumn("c", F.when(F.col("f") < 0, -magnitude).otherwise(magnitude)).drop("f", "q", "pos")
