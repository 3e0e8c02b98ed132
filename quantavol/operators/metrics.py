"""Histograms, entropy and error measures. All are two-level aggregates without Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantavol.options import U16_MAX


def min_max(px: DataFrame, *by: str) -> DataFrame:
    return px.groupBy(*by).agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"))


def histogram(px: DataFrame, *by: str) -> DataFrame:
    """(by..., v, n): how often each sample value stands in each group; 65,536 rows a group at most."""
    return px.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))


def plane_histogram(planes: DataFrame) -> DataFrame:
    return histogram(planes.select("z", F.explode("data").alias("v")), "z")


def entropy(hist: DataFrame, *by: str) -> DataFrame:
    """Shannon entropy in bits of histograms, as log2(N) - sum(n log2 n) / N."""
    n = F.sum("n")
    h = F.log2(n.cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / n
    return hist.filter("n > 0").groupBy(*by).agg((h + 0.0).alias("entropy"), n.alias("n"))


def psnr(mse: Column, peak: int = U16_MAX) -> Column:
    """Decibels of a mean squared error; infinite for none."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(float(peak) * peak) / mse))


def pair_pixels(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """(z, y, x, a, b) of two pixel forms, by place."""
    return original.withColumnRenamed("v", "a").join(decoded.withColumnRenamed("v", "b"), ["z", "y", "x"])


def pair_planes(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """(z, a, b) of two plane forms: planes are joined whole, samples by position."""
    return original.select("z", F.col("data").alias("a")).join(decoded.select("z", F.col("data").alias("b")), "z")


def difference(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """(z, data): original minus decoded."""
    return pair_planes(original, decoded).select("z", F.zip_with("a", "b", lambda x, y: x - y).alias("data"))


def errors(pairs: DataFrame, *by: str) -> DataFrame:
    """abs_sum, mae, mse, psnr and n of pairs (a, b); numerators are exact integers."""
    d = (F.col("a") - F.col("b")).cast("long")
    agg = pairs.groupBy(*by).agg(F.sum(F.abs(d)).alias("abs_sum"), F.sum(d * d).alias("sq_sum"), F.count(F.lit(1)).alias("n"))
    mse = F.col("sq_sum") / F.col("n")
    return agg.select(*by, "abs_sum", (F.col("abs_sum") / F.col("n")).alias("mae"), mse.alias("mse"), psnr(mse).alias("psnr"), "n")


def plane_errors(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """errors() of each plane, without taking planes apart: one row a plane all along."""
    sums = F.aggregate(
        F.zip_with("a", "b", lambda x, y: (x - y).cast("long")),
        F.struct(F.lit(0).cast("long").alias("abs_sum"), F.lit(0).cast("long").alias("sq_sum")),
        lambda s, d: F.struct((s.abs_sum + F.abs(d)).alias("abs_sum"), (s.sq_sum + d * d).alias("sq_sum")),
    )
    got = pair_planes(original, decoded).select("z", sums.alias("s"), F.size("a").cast("long").alias("n"))
    mse = F.col("s.sq_sum") / F.col("n")
    return got.select("z", "s.abs_sum", (F.col("s.abs_sum") / F.col("n")).alias("mae"), mse.alias("mse"), psnr(mse).alias("psnr"), "n")


def means(df: DataFrame, value: str, weight: str, *by: str) -> DataFrame:
    """Arithmetic, Lehmer and weighted Lehmer means; null where a denominator is zero."""
    x, w = F.col(value).cast("double"), F.col(weight).cast("double")
    return df.groupBy(*by).agg(
        F.avg(x).alias("arithmetic"),
        F.try_divide(F.sum(x * x), F.sum(x)).alias("lehmer"),
        F.try_divide(F.sum(w * x * x), F.sum(w * x)).alias("weighted_lehmer"),
    )


def sum_and_max(df: DataFrame, value: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias("sum"), F.max(value).alias("max"))


def dimension_stats(vecs: DataFrame) -> DataFrame:
    """(dim, n, variance, median, min, max, perturbation, deviations) of vector components.

    Variance is of the population, from exact integer moments; deviations is n^2 times that, exactly;
    the median is cut to an integer; the perturbation is a quarter of the spread. All come from the
    histograms of the components. Products of moments pass 64 bits from some ten thousand planes on.
    """
    e = vecs.select(F.posexplode("vec").alias("dim", "v")).withColumn("v", F.col("v").cast("long"))
    wide = lambda c: c.cast("decimal(38,0)")
    v, count = F.col("v"), F.col("c")
    n, s, q = F.sum("c"), wide(F.sum(v * count)), F.sum(wide(v * v) * wide(count))
    got = e.groupBy("dim", "v").agg(F.count(F.lit(1)).alias("c")).groupBy("dim").agg(
        n.alias("n"),
        wide(wide(n) * wide(q) - s * s).alias("deviations"),
        F.percentile("v", 0.5, count).cast("int").alias("median"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    variance = F.col("deviations").cast("double") / (F.col("n").cast("double") * F.col("n"))
    return got.select("dim", "n", variance.alias("variance"), "median", "min", "max", ((F.col("max") - F.col("min")) / 4.0).alias("perturbation"), "deviations")


def widest_dimension(stats: DataFrame) -> DataFrame:
    """The dimension of largest variance, the first of equals; exact, as all dimensions have as many values."""
    return stats.agg(F.max_by("dim", F.struct("deviations", -F.col("dim"))).alias("dim"))


def mean_vector(vecs: DataFrame, length: int) -> list[int]:
    """The mean of all vectors, halves rounded up."""
    row = vecs.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("vec")[i].cast("long")).alias(f"s{i}") for i in range(length))).first()
    return [int((2 * row[f"s{i}"] + row["n"]) // (2 * row["n"])) for i in range(length)]


def chunk_offsets(chunks: DataFrame, header: int = 0) -> DataFrame:
    """offset of each chunk (chunk, n_bytes): what stands before it. Chunks are a row a plane."""
    w = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", (F.lit(header) + F.coalesce(F.sum("n_bytes").over(w), F.lit(0))).cast("long"))


def improvement(log: DataFrame) -> DataFrame:
    """Training logs (iteration, mse) with the gain over the iteration before."""
    w = Window.orderBy("iteration")
    return log.withColumn("gain", F.lag("mse").over(w) - F.col("mse"))


def size_report(chunks: DataFrame, pixels: int, overhead: int) -> DataFrame:
    """Bytes, ratio to the raw volume, and bits a pixel of chunks and what stands around them."""
    total = F.sum("n_bytes").cast("long") + overhead
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), total.alias("bytes"), (total / (2 * pixels)).alias("ratio"), (total * 8.0 / pixels).alias("bpp"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
