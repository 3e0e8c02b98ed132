"""The catalogue of named queries over the standard tables, and their DuckDB oracles.

The image volume of the tests is `embeddings`: plane = vec_id, 64 samples spread over 0..65535, as
8 x 8 or 16 x 4 pixels. `lineitem` gives ragged planes of prices, `events` a stream.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantavol.functions import arrays
from quantavol.operators import codec, kdtree, metrics, scalar, tiling, vector, volume
from quantavol.operators.huffman import HuffmanCode, total_bits
from quantavol.options import Dims, Metric, Mode, QuantOptions, Wrap
from quantavol.plans import reports
from quantavol.sources import codebooks, container, memory, raw
from quantavol.streaming import chunks as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UNIFORM_STEP = 8192
UNIFORM = [UNIFORM_STEP // 2 + UNIFORM_STEP * i for i in range(8)]
EDGES = [(a + b) // 2 for a, b in zip(UNIFORM, UNIFORM[1:])]
TILE_ROW, TILE_BLOCK, TILE_BOX = Dims(3), Dims(3, 3), Dims(3, 3, 3)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.of_signal(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id"), F.col("embedding"))


def depth(planes: DataFrame) -> int:
    return planes.agg((F.max("z") + 1).alias("n")).first()["n"]


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples (z, v) of lineitem."""
    t = table(spark, sf_dir, "lineitem")
    return t.select((F.col("l_linenumber") - 1).cast("int").alias("z"), (F.floor("l_extendedprice") % 65536).cast("int").alias("v"))


def uniform(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, 1) for i, c in enumerate(UNIFORM)], "ix int, centroid int, freq long")


def uniform_book(counts: list[int] | None = None) -> scalar.ScalarCodebook:
    return scalar.ScalarCodebook(np.array(UNIFORM), np.array(counts or [1] * 8))


def as_text(c: Column | str) -> Column:
    return F.array_join(c, ",")


def r4(c: Column | str) -> Column:
    return F.round(c, 4)


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own on the store that all machines share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    root = root or "/tmp/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def px_sql(width: int) -> str:
    return f"""px AS (SELECT CAST(vec_id AS INTEGER) AS z, CAST((i-1)//{width} AS INTEGER) AS y, CAST((i-1)%{width} AS INTEGER) AS x,
 CAST(floor((CAST(embedding[i] AS DOUBLE)+1.0)*32767.5) AS INTEGER) AS v
 FROM (SELECT vec_id, embedding, unnest(range(1,65)) AS i FROM embeddings))"""


PRICES = "sig AS (SELECT CAST(l_linenumber-1 AS INTEGER) AS z, CAST(CAST(floor(l_extendedprice) AS BIGINT)%65536 AS INTEGER) AS v FROM lineitem)"
BOOK = f"book AS (SELECT CAST(i AS INTEGER) AS ix, CAST({UNIFORM_STEP // 2}+{UNIFORM_STEP}*i AS INTEGER) AS centroid FROM range(8) t(i))"
CELLS = """cells AS (SELECT ix, centroid, coalesce((centroid+lag(centroid) OVER (ORDER BY ix))//2, -1) AS lo,
 coalesce((centroid+lead(centroid) OVER (ORDER BY ix))//2, 65535) AS hi FROM book)"""
CODED = "coded AS (SELECT px.*, ix, centroid FROM px JOIN cells ON v > lo AND v <= hi)"


# Volumes, selection, histograms


@query(f"WITH {px_sql(8)} SELECT z, min(v) AS min_v, max(v) AS max_v, CAST(sum(v*(x+8*y)) AS BIGINT) AS checksum, count(*) AS n FROM px GROUP BY z")
def px_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = volume.pixels(volume8(spark, sf_dir), Dims(8, 8))
    at = arrays.linear_index(F.col("x"), F.col("y"), 8)
    return px.groupBy("z").agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.sum(F.col("v") * at).alias("checksum"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {PRICES} SELECT z, v, count(*) AS n FROM sig GROUP BY z, v")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(prices(spark, sf_dir), "z")


@query(f"WITH {PRICES} SELECT z, round(entropy(v), 4) AS entropy, count(*) AS n FROM sig GROUP BY z")
def plane_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.entropy(metrics.histogram(prices(spark, sf_dir), "z"), "z").select("z", r4("entropy").alias("entropy"), "n")


@query(f"WITH {PRICES} SELECT z, min(v) AS min_v, max(v) AS max_v FROM sig GROUP BY z")
def plane_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.min_max(prices(spark, sf_dir), "z")


def _plane_sums(planes: DataFrame) -> DataFrame:
    return planes.select("z", F.aggregate("data", F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query(f"WITH {px_sql(8)} SELECT z, CAST(sum(v) AS BIGINT) AS total FROM px WHERE z BETWEEN 100 AND 149 GROUP BY z")
def plane_select_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane_sums(volume.select_planes(volume8(spark, sf_dir), planes=(100, 149)))


@query(f"WITH {px_sql(8)} SELECT z, CAST(sum(v) AS BIGINT) AS total FROM px WHERE z = 7 GROUP BY z")
def plane_select_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane_sums(volume.select_planes(volume8(spark, sf_dir), 7))


@query(f"WITH {px_sql(8)} SELECT z, CAST(sum(v) AS BIGINT) AS total FROM px WHERE z = (SELECT (max(z)+1)//2 FROM px) GROUP BY z")
def plane_select_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = volume8(spark, sf_dir)
    return _plane_sums(volume.middle_plane(planes, depth(planes)))


@query(f"WITH {px_sql(16)} SELECT z, string_agg(v, ',' ORDER BY y, x) AS data FROM px GROUP BY z")
def planes_from_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = Dims(16, 4)
    return volume.planes_of(volume.pixels(volume8(spark, sf_dir), dims), dims).select("z", as_text("data").alias("data"))


@query("SELECT CAST(i AS INTEGER) AS p, CAST(i%5 AS INTEGER) AS x, CAST((i//5)%4 AS INTEGER) AS y, CAST(i//20 AS INTEGER) AS z, CAST(i AS INTEGER) AS back FROM range(60) t(i)")
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.range(60).select(F.col("id").cast("int").alias("p"), arrays.coordinates(F.col("id"), 5, 4).alias("c")).select("p", "c.*")
    return c.withColumn("back", arrays.linear_index(F.col("x"), F.col("y"), 5, F.col("z"), 20))


@query("SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST((x+10*y+100*z)%65536 AS INTEGER) AS v FROM range(6) a(x), range(5) b(y), range(700) c(z)")
def callback_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = Dims(6, 5, 700)
    return volume.pixels(memory.from_callback(spark, dims, lambda x, y, z: (x + 10 * y + 100 * z) % 65536), dims)


@query("SELECT CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST((x*y*z)%65536 AS INTEGER) AS v FROM range(9) a(x), range(7) b(y), range(300) c(z)")
def expression_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.from_expression(spark, Dims(9, 7, 300), lambda x, y, z: (x * y * z) % 65536)


@query("SELECT CAST(i//12 AS INTEGER) AS z, CAST(sum((i*37)%65536) AS BIGINT) AS total FROM range(1200) t(i) GROUP BY i//12")
def buffer_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = ((np.arange(1200) * 37) % 65536).astype(np.uint16).view(np.int16)
    return _plane_sums(memory.from_flat_buffer(spark, flat, Dims(4, 3, 100)))


# Tiles


def tile_sql(width: int, height: int, tx: int, ty: int, wrap: Wrap) -> str:
    def at(axis: str, size: int) -> str:
        beyond = {Wrap.CLAMP: f"{size - 1}", Wrap.MIRROR: f"{size - 1}-({axis}%{size})", Wrap.BLANK: "-1"}[wrap]
        return f"CASE WHEN {axis} < {size} THEN {axis} ELSE {beyond} END"

    nx, ny = -(-width // tx), -(-height // ty)
    return f"""WITH {px_sql(width)}, pos AS (SELECT b*{nx}+a AS vec_ix, j*{tx}+i AS pos, a*{tx}+i AS sx, b*{ty}+j AS sy
 FROM range({nx}) ta(a), range({ny}) tb(b), range({tx}) ti(i), range({ty}) tj(j)),
 src AS (SELECT vec_ix, pos, {at('sx', width)} AS wx, {at('sy', height)} AS wy FROM pos), zs AS (SELECT DISTINCT z FROM px)
 SELECT zs.z, CAST(vec_ix AS BIGINT) AS vec_ix, string_agg(coalesce(v, 0), ',' ORDER BY pos) AS vec
 FROM zs CROSS JOIN src LEFT JOIN px ON px.z = zs.z AND px.x = wx AND px.y = wy GROUP BY zs.z, vec_ix"""


def _tiled(spark: SparkSession, sf_dir: str, dims: Dims, tile: Dims, wrap: Wrap) -> DataFrame:
    return tiling.tiles(volume8(spark, sf_dir), dims, tile, wrap).select("z", "vec_ix", as_text("vec").alias("vec"))


@query(tile_sql(8, 8, 3, 1, Wrap.MIRROR))
def tile_rows_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, Dims(8, 8), TILE_ROW, Wrap.MIRROR)


@query(tile_sql(8, 8, 3, 1, Wrap.CLAMP))
def tile_rows_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, Dims(8, 8), TILE_ROW, Wrap.CLAMP)


@query(tile_sql(8, 8, 3, 1, Wrap.BLANK))
def tile_rows_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, Dims(8, 8), TILE_ROW, Wrap.BLANK)


@query(tile_sql(16, 4, 3, 3, Wrap.MIRROR))
def tile_blocks_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, Dims(16, 4), TILE_BLOCK, Wrap.MIRROR)


@query(tile_sql(16, 4, 5, 3, Wrap.CLAMP))
def tile_blocks_5x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiled(spark, sf_dir, Dims(16, 4), Dims(5, 3), Wrap.CLAMP)


VOXELS = f"""WITH {px_sql(8)}, size AS (SELECT max(z)+1 AS d, greatest(1, (max(z)+1)//3) AS n FROM px),
 layers AS (SELECT CAST(l AS INTEGER) AS l, CASE WHEN l = n-1 THEN d-3*(n-1) ELSE 3 END AS deep FROM size, range(100000) t(l) WHERE l < n),
 pos AS (SELECT l, (c*3+b)*3+a AS vec_ix, (k*3+j)*3+i AS pos, a*3+i AS sx, b*3+j AS sy, c*3+k AS sz, deep
  FROM layers, range(3) ta(a), range(3) tb(b), range(2) tc(c), range(3) ti(i), range(3) tj(j), range(3) tk(k) WHERE c*3 < deep),
 src AS (SELECT l, vec_ix, pos, CASE WHEN sx<8 THEN sx ELSE 7-(sx%8) END AS wx, CASE WHEN sy<8 THEN sy ELSE 7-(sy%8) END AS wy,
  3*l + CASE WHEN sz<deep THEN sz ELSE deep-1-(sz%deep) END AS wz FROM pos)
 SELECT l AS z, CAST(vec_ix AS BIGINT) AS vec_ix, string_agg(v, ',' ORDER BY pos) AS vec
 FROM src JOIN px ON px.z = wz AND px.x = wx AND px.y = wy GROUP BY l, vec_ix"""


@query(VOXELS)
def tile_voxels_3x3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = volume8(spark, sf_dir)
    return tiling.tiles(planes, Dims(8, 8, depth(planes)), TILE_BOX).select("z", "vec_ix", as_text("vec").alias("vec"))


@query("""WITH zs AS (SELECT CAST(vec_id AS INTEGER) AS z FROM embeddings), size AS (SELECT max(z)+1 AS d FROM zs)
 SELECT CAST(least(z//3, greatest(1, d//3)-1) AS INTEGER) AS layer, min(z) AS first_z, max(z) AS last_z, count(*) AS planes FROM zs, size GROUP BY 1""")
def voxel_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("z"))
    layers = z.withColumn("layer", tiling.layer_of(F.col("z"), depth(z), 3))
    return layers.groupBy("layer").agg(F.min("z").alias("first_z"), F.max("z").alias("last_z"), F.count(F.lit(1)).alias("planes"))


@query(f"WITH {px_sql(16)} SELECT z, y, x, v FROM px")
def untile_blocks_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims, tile = Dims(16, 4), Dims(5, 3)
    return volume.pixels(tiling.untile(tiling.tiles(volume8(spark, sf_dir), dims, tile), dims, tile), dims)


@query(f"WITH {px_sql(8)} SELECT z, y, x, v FROM px")
def untile_voxels_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = volume8(spark, sf_dir)
    dims = Dims(8, 8, depth(planes))
    return volume.pixels(tiling.untile(tiling.tiles(planes, dims, TILE_BOX), dims, TILE_BOX), dims)


# Scalar quantization


@query(f"WITH {px_sql(8)}, e AS (SELECT z, CAST(len(list_filter({EDGES}, lambda b: v > b)) AS INTEGER) AS ix FROM px) SELECT z, ix, count(*) AS n FROM e GROUP BY z, ix")
def sq_uniform_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = volume.pixels(volume8(spark, sf_dir), Dims(8, 8))
    return px.select("z", scalar.encode_column(F.col("v"), EDGES).alias("ix")).groupBy("z", "ix").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {px_sql(8)}, {BOOK}, {CELLS}, {CODED} SELECT z, y, x, v, ix, centroid FROM coded")
def sq_range_join_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar.encode_by_join(volume.pixels(volume8(spark, sf_dir), Dims(8, 8)), uniform(spark)).select("z", "y", "x", "v", "ix", "centroid")


@query(f"""WITH {PRICES}, {BOOK}, {CELLS}, hist AS (SELECT v, count(*) AS n FROM sig GROUP BY v),
 got AS (SELECT ix, CAST(sum(v*n)//sum(n) AS INTEGER) AS moved, CAST(sum(n) AS BIGINT) AS n FROM hist JOIN cells ON v BETWEEN greatest(lo, 0) AND hi GROUP BY ix)
 SELECT book.ix, coalesce(moved, centroid) AS centroid, coalesce(n, 0) AS n FROM book LEFT JOIN got USING (ix)""")
def lloyd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar.lloyd_step(metrics.histogram(prices(spark, sf_dir)), uniform(spark))


@query(f"""WITH {PRICES}, {BOOK}, {CELLS}, hist AS (SELECT v, count(*) AS n FROM sig GROUP BY v),
 r AS (SELECT ix, v, row_number() OVER (PARTITION BY ix ORDER BY n DESC, v) AS k FROM hist JOIN cells ON v BETWEEN greatest(lo, 0) AND hi)
 SELECT ix, v AS mode FROM r WHERE k = 1""")
def lloyd_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar.mode_of_cells(metrics.histogram(prices(spark, sf_dir)), uniform(spark))


SQ_ERRORS = f"""WITH {px_sql(8)}, {BOOK}, {CELLS}, {CODED}, e AS (SELECT z, CAST(sum(abs(v-centroid)) AS BIGINT) AS abs_sum,
 CAST(sum(CAST(v-centroid AS BIGINT)*(v-centroid)) AS BIGINT) AS sq, count(*) AS n FROM coded GROUP BY z)
 SELECT z, abs_sum, round(abs_sum/n, 4) AS mae, round(sq/n, 4) AS mse, round(10*log10(4294836225.0/(sq/n)), 4) AS psnr, n FROM e"""


def _rounded_errors(df: DataFrame) -> DataFrame:
    return df.select("z", "abs_sum", r4("mae").alias("mae"), r4("mse").alias("mse"), r4("psnr").alias("psnr"), "n")


@query(SQ_ERRORS)
def sq_plane_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = volume8(spark, sf_dir)
    return _rounded_errors(metrics.plane_errors(planes, scalar.quantize_planes(planes, uniform_book())))


@query(SQ_ERRORS)
def sq_pixel_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = volume.pixels(volume8(spark, sf_dir), Dims(8, 8))
    decoded = scalar.encode_by_join(px, uniform(spark)).select("z", "y", "x", F.col("centroid").alias("v"))
    return _rounded_errors(metrics.errors(metrics.pair_pixels(px, decoded), "z"))


@query(f"""WITH {px_sql(8)}, {BOOK}, {CELLS}, {CODED} SELECT z, CAST(sum(v-centroid) AS BIGINT) AS diff, CAST(sum(abs(v-centroid)) AS BIGINT) AS abs_diff FROM coded GROUP BY z""")
def plane_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = volume8(spark, sf_dir)
    d = reports.plane_difference(planes, scalar.quantize_planes(planes, uniform_book()))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    return d.select("z", total("diff").alias("diff"), total("abs_diff").alias("abs_diff"))


def lloyd_sql(k: int, result: str) -> str:
    """Training over the histogram as a recursion over lists: ten updates between two looks at the error."""
    return f"""WITH RECURSIVE {px_sql(8)}, hist AS (SELECT v, count(*) AS n FROM px GROUP BY v),
 lim AS (SELECT min(v) AS low, max(v) AS high FROM hist),
 runs AS (SELECT list(CAST(m AS BIGINT) ORDER BY i) AS mass, list(CAST(s AS BIGINT) ORDER BY i) AS moment FROM
  (SELECT i, sum(coalesce(n, 0)) OVER w AS m, sum(coalesce(n, 0)*i) OVER w AS s FROM range(65536) r(i) LEFT JOIN hist ON v = i WINDOW w AS (ORDER BY i))),
 begin AS (SELECT list(CAST(low + floor((i+0.5)*((high-low)/CAST({k} AS DOUBLE))) AS BIGINT) ORDER BY i) AS c FROM lim, range({k}) r(i)),
 edged AS (SELECT c, list_concat([CAST(low AS BIGINT)], list_transform(range(1, {k}), lambda i: least(CAST(high AS BIGINT), (c[i]+c[i+1])//2)), [CAST(high AS BIGINT)]) AS e FROM begin, lim),
 modes AS (SELECT i, (SELECT arg_max(v, n*65536-v) FROM hist WHERE v BETWEEN e[i] AND e[i+1]) AS m, c[i] AS was FROM edged, range(1, {k}+1) r(i)),
 start AS (SELECT list(CAST(coalesce(m, was) AS BIGINT) ORDER BY i) AS c FROM modes),
 steps AS (
  SELECT 0 AS it, c, (SELECT e FROM edged) AS e, CAST(NULL AS DOUBLE) AS before, (SELECT CAST(sum(n*(v-c[len(list_filter(f[2:{k}], lambda b: b < v))+1])*(v-c[len(list_filter(f[2:{k}], lambda b: b < v))+1])) AS DOUBLE)/sum(n) FROM hist, (SELECT e AS f FROM edged)) AS mse FROM start
  UNION ALL
  SELECT it+1, d, e2, CASE WHEN it%10 = 9 THEN mse ELSE before END, CASE WHEN it%10 = 9 THEN
    (SELECT CAST(sum(n*(v-d[len(list_filter(e2[2:{k}], lambda b: b < v))+1])*(v-d[len(list_filter(e2[2:{k}], lambda b: b < v))+1])) AS DOUBLE)/sum(n) FROM hist) ELSE mse END
  FROM (SELECT it, e2, before, mse, list_transform(range(1, {k}+1), lambda i: CASE WHEN e2[i+1] >= e2[i] AND mass[e2[i+1]+1] > coalesce(CASE WHEN e2[i] > 0 THEN mass[e2[i]] END, 0)
     THEN (moment[e2[i+1]+1]-coalesce(CASE WHEN e2[i] > 0 THEN moment[e2[i]] END, 0))//(mass[e2[i+1]+1]-coalesce(CASE WHEN e2[i] > 0 THEN mass[e2[i]] END, 0)) ELSE c[i] END) AS d
   FROM (SELECT it, c, before, mse, mass, moment, list_concat([CAST(low AS BIGINT)], list_transform(range(1, {k}), lambda i: least(CAST(high AS BIGINT), (c[i]+c[i+1])//2)), [CAST(high AS BIGINT)]) AS e2
    FROM steps, lim, runs WHERE it < 10 OR it%10 <> 0 OR before - mse >= 1)))
 {result}"""


TRAINED = """SELECT CAST(i-1 AS INTEGER) AS ix, CAST(c[i] AS INTEGER) AS centroid, CAST((SELECT coalesce(sum(n), 0) FROM hist WHERE (i = 1 OR v > e[i]) AND (i = 16 OR v <= e[i+1])) AS BIGINT) AS freq FROM (SELECT c, e FROM steps ORDER BY it DESC LIMIT 1), range(1, 17) r(i)"""
TRAIN_LOG = """SELECT CAST(it//10 AS INTEGER) AS iteration, round(mse, 4) AS mse, round(10*log10(65535.0*65535/mse), 4) AS psnr,
 round(lag(mse) OVER (ORDER BY it) - mse, 4) AS gain FROM steps WHERE it%10 = 0"""


@query(lloyd_sql(16, TRAINED))
def lloyd_max_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scalar.train(volume8(spark, sf_dir), 16)
    return got.codebook.frame(spark)


@query(lloyd_sql(8, TRAIN_LOG))
def lloyd_max_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors at each look and what they gained, to four decimals."""
    log = metrics.improvement(scalar.log_frame(spark, scalar.train(volume8(spark, sf_dir), 8).log))
    return log.select("iteration", *(r4(c).alias(c) for c in ("mse", "psnr", "gain")))


@query()
def lloyd_max_each_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar.train_each(volume8(spark, sf_dir), 4)


# Vector quantization: rows of 8 samples against the 8 rows of plane 0

TILE8 = Dims(8)
VECS = f"""{px_sql(8)}, vecs AS (SELECT z, CAST(y AS BIGINT) AS vec_ix, list(v ORDER BY x) AS vec FROM px GROUP BY z, y),
 vbook AS (SELECT CAST(vec_ix AS INTEGER) AS ix, vec AS cv FROM vecs WHERE z = 0),
 dist AS (SELECT z, vec_ix, vec, ix, cv, list_sum(list_transform(range(1, 9), lambda i: CAST(vec[i]-cv[i] AS BIGINT)*(vec[i]-cv[i]))) AS d2 FROM vecs, vbook),
 best AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY z, vec_ix ORDER BY d2, ix) AS k FROM dist) WHERE k = 1)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tiles(volume8(spark, sf_dir), Dims(8, 8), TILE8)


def row_book(vecs: DataFrame) -> vector.VectorCodebook:
    rows = vecs.filter("z = 0").select(F.col("vec_ix").cast("int").alias("ix"), "vec", F.lit(1).cast("long").alias("freq")).collect()
    return vector.VectorCodebook.of_rows(rows, TILE8)


@query(f"WITH {VECS} SELECT z, vec_ix, ix, CAST(d2 AS BIGINT) AS d2 FROM best")
def vq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = vectors(spark, sf_dir)
    return vector.assign(vecs, row_book(vecs)).select("z", "vec_ix", "ix", F.col("d2").cast("long").alias("d2"))


@query(f"WITH {VECS} SELECT z, vec_ix, ix, CAST(d2 AS BIGINT) AS d2 FROM best")
def vq_assign_by_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a KD-tree, all leaves allowed."""
    vecs = vectors(spark, sf_dir)
    return kdtree.assign(vecs, row_book(vecs).vectors, bucket=2).select("z", "vec_ix", "ix", F.col("d2").cast("long").alias("d2"))


@query(f"WITH {VECS} SELECT z, vec_ix, ix, round(sqrt(d2), 4) AS dist FROM best")
def vq_assign_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = vectors(spark, sf_dir)
    book = row_book(vecs).frame(spark)
    return vector.assign_by_join(vecs, book).select("z", "vec_ix", "ix", r4("dist").alias("dist"))


@query(f"""WITH {VECS}, pair AS (SELECT a.z, a.vec_ix, list_transform(range(1, 9), lambda i: CAST(abs(a.vec[i]-b.vec[i]) AS DOUBLE)) AS d FROM vecs a JOIN vecs b ON b.z = a.z+1 AND b.vec_ix = a.vec_ix)
 SELECT z, vec_ix, list_sum(d) AS manhattan, round(sqrt(list_sum(list_transform(d, lambda x: x*x))), 4) AS euclidean, list_max(d) AS max_diff FROM pair""")
def vq_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = vectors(spark, sf_dir)
    b = a.select((F.col("z") - 1).alias("z"), "vec_ix", F.col("vec").alias("other"))
    d = lambda m: arrays.distance("vec", "other", m)
    return a.join(b, ["z", "vec_ix"]).select("z", "vec_ix", d(Metric.MANHATTAN).alias("manhattan"), r4(d(Metric.EUCLIDEAN)).alias("euclidean"), d(Metric.MAX_DIFF).alias("max_diff"))


STATS = f"""WITH {VECS}, dims AS (SELECT ix, i, sum(vec[i]) AS s, count(*) AS n, min(vec[i]) AS lo, max(vec[i]) AS hi FROM best, range(1, 9) t(i) GROUP BY ix, i),
 per AS (SELECT ix, count(*) AS n, sum(sqrt(d2)) AS dist FROM best GROUP BY ix)"""


@query(f"""{STATS} SELECT per.ix, per.n, round(per.dist, 4) AS dist_sum, round(per.dist/per.n, 4) AS avg_dist,
 string_agg(CAST(floor(s/dims.n+0.5) AS INTEGER), ',' ORDER BY i) AS centroid, round(sum((hi-lo)/4.0), 4) AS perturbation
 FROM per JOIN dims USING (ix) GROUP BY per.ix, per.n, per.dist""")
def vq_entry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = vectors(spark, sf_dir)
    s = vector.entry_stats(vector.assign(vecs, row_book(vecs)), 8)
    total = F.aggregate("perturbation", F.lit(0.0), lambda a, x: a + x)
    return s.select("ix", "n", r4("dist_sum").alias("dist_sum"), r4("avg_dist").alias("avg_dist"), as_text("centroid").alias("centroid"), r4(total).alias("perturbation"))


@query(f"{STATS} SELECT round(avg(dist/n), 4) AS distortion FROM per")
def vq_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = vectors(spark, sf_dir)
    return vector.mean_distortion(vector.entry_stats(vector.assign(vecs, row_book(vecs)), 8)).select(r4("distortion").alias("distortion"))


@query(f"WITH {VECS} SELECT CAST(i AS INTEGER) AS ix, coalesce((SELECT count(*) FROM best WHERE ix = i), 0) AS n FROM range(16) t(i)")
def vq_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = vectors(spark, sf_dir)
    return vector.frequencies(vector.assign(vecs, row_book(vecs)), 16)


@query(f"WITH {VECS} SELECT z, vec_ix, ix, array_to_string(cv, ',') AS vec FROM best")
def vq_decode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = vectors(spark, sf_dir)
    book = row_book(vecs)
    return vector.decode(vector.assign(vecs, book).select("z", "vec_ix", "ix"), book.frame(spark)).select("z", "vec_ix", "ix", as_text("vec").alias("vec"))


@query(f"WITH {VECS}, u AS (SELECT count(*) AS n FROM (SELECT DISTINCT vec FROM vecs)) SELECT n AS distinct_vectors, n > 256 AS more_than_256 FROM u")
def vq_unique_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = vectors(spark, sf_dir)
    return vecs.agg(F.countDistinct("vec").alias("distinct_vectors")).withColumn("more_than_256", F.lit(vector.has_more_than(vecs, 256)))


DIMS = f"""WITH {VECS}, c AS (SELECT CAST(i-1 AS INTEGER) AS dim, CAST(vec[i] AS BIGINT) AS v FROM vecs, range(1, 9) t(i)),
 s AS (SELECT dim, count(*) AS n, sum(v) AS s, sum(v*v) AS q, CAST(trunc(quantile_cont(v, 0.5)) AS INTEGER) AS median, min(v) AS lo, max(v) AS hi FROM c GROUP BY dim)"""


@query(f"{DIMS} SELECT dim, n, round((n*q-s*s)/(CAST(n AS DOUBLE)*n), 4) AS variance, median, lo AS min, hi AS max, round((hi-lo)/4.0, 4) AS perturbation FROM s")
def vq_dimension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.dimension_stats(vectors(spark, sf_dir))
    return d.select("dim", "n", r4("variance").alias("variance"), "median", "min", "max", r4("perturbation").alias("perturbation"))


@query(f"{DIMS} SELECT dim FROM s ORDER BY n*q-s*s DESC, dim LIMIT 1")
def vq_widest_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.widest_dimension(metrics.dimension_stats(vectors(spark, sf_dir)))


@query(f"{DIMS} SELECT dim, CAST(floor(s/n+0.5) AS BIGINT) AS mean FROM s")
def vq_mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = metrics.mean_vector(vectors(spark, sf_dir), 8)
    return spark.createDataFrame(list(enumerate(mean)), "dim int, mean long")


@query(f"""{STATS}, one AS (SELECT ix, i, floor(s/n+0.5) AS c, (hi-lo)/4.0 AS p FROM dims)
 SELECT ix, string_agg(CAST(trunc(c+p) AS INTEGER), ',' ORDER BY i) AS right_child, string_agg(CAST(trunc(c-p) AS INTEGER), ',' ORDER BY i) AS left_child FROM one GROUP BY ix""")
def vq_split_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = vectors(spark, sf_dir)
    s = vector.entry_stats(vector.assign(vecs, row_book(vecs)), 8)
    child = lambda plus: as_text(vector.perturbed(F.col("centroid"), F.col("perturbation"), plus))
    return s.select("ix", child(True).alias("right_child"), child(False).alias("left_child"))


@query()
def vq_lbg_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.train(vectors(spark, sf_dir), 16, TILE8).codebook.frame(spark)


@query()
def vq_lbg_train_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.train(vectors(spark, sf_dir), 4, TILE8, local_samples=0).codebook.frame(spark)


@query()
def vq_lbg_all_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = vector.train_all_sizes(vectors(spark, sf_dir), TILE8, 32)
    return metrics.union([b.frame(spark).withColumn("k", F.lit(len(b.vectors))) for b in books])


# Entropy coding and codecs

HEAP = """h AS (SELECT list_sort(list(n)) AS l, CAST(0 AS BIGINT) AS cost FROM counts
 UNION ALL SELECT list_sort(list_append(l[3:], l[1]+l[2])), cost + l[1] + l[2] FROM h WHERE len(l) > 1)"""
COUNTS = f"""{px_sql(8)}, {BOOK}, {CELLS}, {CODED}, counts AS (SELECT book.ix, count(coded.v) AS n FROM book LEFT JOIN coded USING (ix) GROUP BY book.ix)"""


def uniform_counts(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    px = volume.pixels(volume8(spark, sf_dir), Dims(8, 8)).withColumn("ix", scalar.encode_column(F.col("v"), EDGES))
    return px.groupBy(*by, "ix").agg(F.count(F.lit(1)).alias("n"))


def counted_book(spark: SparkSession, sf_dir: str) -> scalar.ScalarCodebook:
    n = {r["ix"]: r["n"] for r in uniform_counts(spark, sf_dir).collect()}
    return uniform_book([n.get(i, 0) for i in range(8)])


@query(f"WITH RECURSIVE {COUNTS}, {HEAP} SELECT max(cost) AS bits, CAST((max(cost)+7)//8 AS BIGINT) AS n_bytes FROM h")
def huffman_total_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = HuffmanCode(counted_book(spark, sf_dir).frequencies).frame(spark)
    return total_bits(uniform_counts(spark, sf_dir), code)


@query()
def huffman_plane_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = HuffmanCode(counted_book(spark, sf_dir).frequencies).frame(spark)
    return total_bits(uniform_counts(spark, sf_dir, "z"), code, "z")


@query(f"WITH {COUNTS} SELECT ix, round(n/(SELECT sum(n) FROM counts), 4) AS share FROM counts")
def huffman_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = HuffmanCode(counted_book(spark, sf_dir).frequencies).probabilities()
    return spark.createDataFrame(p, "ix int, share double").select("ix", r4("share").alias("share"))


@query(SQ_ERRORS)
def sq_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = volume8(spark, sf_dir)
    options = QuantOptions(Dims(8, 8, depth(planes)), 3, mode=Mode.GLOBAL)
    return _rounded_errors(reports.roundtrip(planes, options, counted_book(spark, sf_dir)))


@query(f"WITH {VECS} SELECT z, CAST(sum(d2) AS BIGINT) AS sq_sum FROM best GROUP BY z")
def vq_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = volume8(spark, sf_dir)
    options = QuantOptions(Dims(8, 8, depth(planes)), 3, TILE8, Mode.GLOBAL)
    e = reports.roundtrip(planes, options, row_book(vectors(spark, sf_dir)))
    return e.select("z", F.round(F.col("mse") * F.col("n")).cast("long").alias("sq_sum"))


@query()
def voxel_codec_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors over all planes, of more different boxes than codewords."""
    planes = volume8(spark, sf_dir)
    return _rounded_errors(reports.roundtrip(planes, QuantOptions(Dims(8, 8, depth(planes)), 8, Dims(4, 4, 4), Mode.GLOBAL)))


@query(f"WITH {px_sql(16)} SELECT z, y, x, v FROM px")
def individual_codec_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All planes: each has 8 tiles at most, fewer than its codebook's words."""
    planes = volume8(spark, sf_dir)
    options = QuantOptions(Dims(16, 4, depth(planes)), 5, Dims(5, 3))
    decoded = codec.decompress(codec.compress(planes, options), options.dims, options.tile, 32)
    return volume.pixels(decoded, options.dims)


@query(SQ_ERRORS)
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes, path = volume8(spark, sf_dir), scratch(spark, "container") + "/v.volume"
    options = QuantOptions(Dims(8, 8, depth(planes)), 3, mode=Mode.GLOBAL)
    book = counted_book(spark, sf_dir)
    container.write_container(codec.compress(planes, options, book), path, container.Header.of_options(options), book)
    return _rounded_errors(metrics.plane_errors(planes, reports.open_container(spark, path)))


@query(f"WITH {px_sql(16)} SELECT z, y, x, v FROM px")
def raw_volume_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes, path = volume8(spark, sf_dir), scratch(spark, "raw") + "/v.raw"
    raw.register(spark)
    planes.write.format("u16raw").mode("append").save(path)
    dims = Dims(16, 4, depth(planes))
    return volume.pixels(spark.read.format("u16raw").option("dims", str(dims)).load(path), dims)


@query("SELECT CAST(i AS INTEGER) AS ix, CAST(4096+8192*i AS INTEGER) AS centroid, CAST(1 AS BIGINT) AS freq FROM range(8) t(i)")
def codebook_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch(spark, "store")
    codebooks.save(spark, store, "uniform", uniform_book())
    codebooks.save(spark, store, "other", uniform_book([2] * 8))
    if codebooks.available(spark, store, "uniform") != [3] or not codebooks.exists(spark, store, "other", 8):
        raise AssertionError("a saved codebook is missing")
    return codebooks.load(spark, store, "uniform", 8).frame(spark)


CHUNK_SIZES = f"WITH {px_sql(8)}, c AS (SELECT z AS chunk, CAST(min(v)%100+1 AS BIGINT) AS n_bytes FROM px GROUP BY z)"


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume8(spark, sf_dir).select(F.col("z").alias("chunk"), (F.array_min("data") % 100 + 1).cast("long").alias("n_bytes"))


@query(f"{CHUNK_SIZES} SELECT chunk, n_bytes, CAST(23 + coalesce(sum(n_bytes) OVER (ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM c")
def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.chunk_offsets(chunk_sizes(spark, sf_dir), 23)


@query(f"{CHUNK_SIZES} SELECT count(*) AS chunks, CAST(sum(n_bytes)+100 AS BIGINT) AS bytes, round((sum(n_bytes)+100)/(2*64.0*count(*)), 4) AS ratio, round((sum(n_bytes)+100)*8.0/(64*count(*)), 4) AS bpp FROM c")
def container_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = chunk_sizes(spark, sf_dir)
    r = metrics.size_report(sizes, 64 * sizes.count(), 100)
    return r.select("chunks", "bytes", r4("ratio").alias("ratio"), r4("bpp").alias("bpp"))


@query(f"{CHUNK_SIZES} SELECT chunk AS iteration, CAST(n_bytes AS DOUBLE) AS mse, CAST(lag(n_bytes) OVER (ORDER BY chunk)-n_bytes AS DOUBLE) AS gain FROM c")
def train_log_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.improvement(chunk_sizes(spark, sf_dir).select(F.col("chunk").alias("iteration"), F.col("n_bytes").cast("double").alias("mse")))


# Functions


@query("""SELECT l_returnflag AS flag, round(avg(CAST(l_quantity AS DOUBLE)), 4) AS arithmetic, round(sum(l_quantity*l_quantity)/sum(l_quantity), 4) AS lehmer,
 round(sum(l_linenumber*l_quantity*l_quantity)/sum(l_linenumber*l_quantity), 4) AS weighted_lehmer FROM lineitem GROUP BY l_returnflag""")
def lehmer_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.means(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber", "l_returnflag")
    return m.select(F.col("l_returnflag").alias("flag"), *(r4(c).alias(c) for c in ("arithmetic", "lehmer", "weighted_lehmer")))


@query("SELECT l_returnflag AS flag, CAST(sum(l_linenumber) AS BIGINT) AS sum, max(l_linenumber) AS max FROM lineitem GROUP BY l_returnflag")
def sum_and_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sum_and_max(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag").withColumnRenamed("l_returnflag", "flag")


@query(f"WITH {px_sql(8)} SELECT z, string_agg(printf('%04X', v), '' ORDER BY y, x) AS big, string_agg(printf('%02X%02X', v%256, v//256), '' ORDER BY y, x) AS little, CAST(sum(v) AS BIGINT) AS total FROM px GROUP BY z")
def u16_bytes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = volume8(spark, sf_dir).select("z", arrays.bytes_of_samples("data").alias("b"), arrays.bytes_of_samples("data", True).alias("l"))
    total = F.aggregate(arrays.samples_of_bytes("b"), F.lit(0).cast("long"), lambda s, v: s + v)
    return b.select("z", F.hex("b").alias("big"), F.hex("l").alias("little"), total.alias("total"))


@query(f"WITH {px_sql(8)} SELECT z, string_agg(printf('%08X', CASE WHEN v-32768 < 0 THEN 4294967296+v-32768 ELSE CAST(v-32768 AS BIGINT) END), '' ORDER BY y, x) AS big FROM px GROUP BY z")
def i32_bytes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume8(spark, sf_dir).select("z", F.hex(arrays.bytes_of_ints(F.transform("data", lambda v: v - 32768))).alias("big"))


@query("""SELECT p_partkey, CASE WHEN p_size%4 > 1 THEN 'VECTOR_3D' WHEN p_size%3 > 0 THEN 'VECTOR_2D' WHEN p_size > 1 THEN 'VECTOR_1D' ELSE 'SCALAR' END AS kind,
 CAST(floor(log2(p_size)) AS INTEGER) AS bits, CAST(p_size%7 AS INTEGER) AS y, printf('%d:%02d:%02d.%03d', (p_partkey*p_size)//3600000, (p_partkey*p_size)//60000%60, (p_partkey*p_size)//1000%60, (p_partkey*p_size)%1000) AS elapsed FROM part""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    dims = arrays.dims_of_text(F.format_string("%d x %d x 2", s, s % 7))
    ms = F.col("p_partkey") * s
    kind = arrays.quantization_of(s, s % 3 + 1, s % 4)
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), arrays.bits_of_size(s).alias("bits"), dims["y"].alias("y"), arrays.elapsed_text(ms).alias("elapsed"))


@query(f"""WITH {px_sql(8)}, p AS (SELECT z, list(v ORDER BY y, x) AS d FROM px GROUP BY z) SELECT z, list_contains(d, d[5]) AND list_contains(d[1:8], d[3]) AS holds,
 list_contains(d[1:8], 70000) AS holds_not, d[19] AS at_2_2, list_bool_and(list_transform(d, lambda v: v = 0)) AS zero FROM p""")
def array_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = volume8(spark, sf_dir)
    both = arrays.holds("data", F.col("data")[4]) & arrays.holds("data", F.col("data")[2], 8)
    return p.select("z", both.alias("holds"), arrays.holds("data", 70000, 8).alias("holds_not"), arrays.sample_at("data", F.lit(2), F.lit(2), 8).alias("at_2_2"), arrays.is_zero("data").alias("zero"))


@query("SELECT CAST(i AS INTEGER) AS i, CAST(i+2 AS INTEGER) AS sum_x, CAST(2*i-3 AS INTEGER) AS diff_y, CAST(i AS BIGINT)*2*i*5 AS product, (i*331)%65536 AS checked, (i*331-65536)%65536+65536 AS signed_back FROM range(1, 150) t(i)")
def struct_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    a = F.struct(i.alias("x"), (2 * i).alias("y"), F.lit(5).alias("z"))
    b = F.struct(F.lit(2).alias("x"), F.lit(3).alias("y"), F.lit(1).alias("z"))
    df = spark.range(1, 150).select(F.col("id").cast("int").alias("i"))
    add, sub = arrays.add(a, b, "x", "y", "z"), arrays.subtract(a, b, "x", "y", "z")
    v = (i * 331) % 65536
    return df.select("i", add["x"].alias("sum_x"), sub["y"].alias("diff_y"), arrays.product(a, "x", "y", "z").alias("product"), arrays.checked16(v).cast("long").alias("checked"), arrays.unsigned16(v - 65536).cast("long").alias("signed_back"))


@query(f"WITH {VECS}, own AS (SELECT z, CAST(vec_ix AS INTEGER) AS ix, vec FROM vecs) SELECT best.z, vec_ix, best.ix, array_to_string(own.vec, ',') AS vec FROM best JOIN own ON own.z = best.z AND own.ix = best.ix")
def decode_by_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices looked up in a codebook for each plane, here the plane's own rows."""
    vecs = vectors(spark, sf_dir)
    books = vecs.select("z", F.col("vec_ix").cast("int").alias("ix"), "vec")
    ix = vector.assign(vecs, row_book(vecs)).select("z", "vec_ix", "ix")
    return vector.decode(ix, books, by_plane=True).select("z", "vec_ix", "ix", as_text("vec").alias("vec"))


@query(f"WITH {PRICES} SELECT CAST(z AS VARCHAR) AS z, printf('%.4f', entropy(v)) AS entropy FROM sig GROUP BY z")
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as CSV and read back as text."""
    path = scratch(spark, "csv")
    reports.write_csv(metrics.entropy(metrics.histogram(prices(spark, sf_dir), "z"), "z").select("z", "entropy"), path)
    return spark.read.option("sep", ";").option("header", True).csv(path)


@query("SELECT count(*) AS chunks, true AS bounded FROM embeddings")
def container_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a written container; their bytes lie between the coded bits and a byte more for each chunk."""
    planes, path = volume8(spark, sf_dir), scratch(spark, "inspect") + "/v.volume"
    options = QuantOptions(Dims(8, 8, depth(planes)), 3, mode=Mode.GLOBAL)
    book = counted_book(spark, sf_dir)
    container.write_container(codec.compress(planes, options, book), path, container.Header.of_options(options), book)
    chunks, head, _ = container.read_container(spark, path)
    bits = HuffmanCode(book.frequencies).total_bits
    n = F.sum("n_bytes") * 8
    return reports.inspect_frame(chunks, head).agg(F.count(F.lit(1)).alias("chunks"), ((n >= bits) & (n < bits + 8 * F.count(F.lit(1)))).alias("bounded"))


@query("""SELECT CAST(l_linenumber-1 AS INTEGER) AS z, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 3, 6) GROUP BY 1""")
def codebook_store_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of the planes that a codebook store has a codebook of 8 words for: a semi join with its keys."""
    store = scratch(spark, "keys")
    for z in (0, 2, 5):
        codebooks.save(spark, store, str(z), uniform_book())
    codebooks.save(spark, store, "3", scalar.ScalarCodebook(np.array([1, 2]), np.array([1, 1])))
    keys = codebooks.keys(spark, store).filter("k = 8").select(F.col("train_name").cast("int").alias("z"))
    return prices(spark, sf_dir).join(keys, "z", "left_semi").groupBy("z").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(l_linenumber-1 AS INTEGER) AS z, count(*) AS n FROM lineitem WHERE l_linenumber-1 IN (SELECT vec_id FROM embeddings) GROUP BY 1""")
def codebook_exists_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The semi join with the keys of all vectors."""
    store = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("z")).distinct()
    return prices(spark, sf_dir).join(store, "z", "left_semi").groupBy("z").agg(F.count(F.lit(1)).alias("n"))


# Commands


def raw_file(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, Dims]:
    """The volume as a raw file of planes of 16 x 4."""
    planes, path = volume8(spark, sf_dir), scratch(spark, name) + "/v.raw"
    raw.register(spark)
    planes.write.format("u16raw").mode("append").save(path)
    return path, Dims(16, 4, depth(planes))


@query(f"WITH {px_sql(16)} SELECT z, y, x, v FROM px")
def command_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compress and decompress commands, file to file; planes of fewer tiles than codewords lose nothing."""
    path, dims = raw_file(spark, sf_dir, "commands")
    reports.run_command(spark, ["-c", "-vq", "4x4", "-b", "3", "-o", f"{path}.volume", path, str(dims)], lambda line: None)
    reports.run_command(spark, ["-d", "-o", f"{path}.back", f"{path}.volume"], lambda line: None)
    return volume.pixels(raw.read(spark, f"{path}.back", dims), dims)


@query("SELECT CAST(0.0 AS DOUBLE) AS mae, CAST(0.0 AS DOUBLE) AS mse, CAST(count(*) * 64 AS BIGINT) AS n FROM embeddings")
def command_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark command on a codec that loses nothing, and the number of samples it took."""
    path, dims = raw_file(spark, sf_dir, "benchmark")
    out = reports.run_command(spark, ["-bench", "-vq", "4x4", "-b", "3", path, str(dims)], lambda line: None)
    return out.select("mae", "mse", F.lit(dims.count).cast("long").alias("n"))


@query(lloyd_sql(16, TRAINED))
def command_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training command, and the codebook that it leaves in its store."""
    path, dims = raw_file(spark, sf_dir, "training")
    store = scratch(spark, "training-store")
    reports.run_command(spark, ["-tcb", "-sq", "-b", "4", "-o", store, path, str(dims)], lambda line: None)
    return codebooks.load(spark, store, "v.raw", 16).frame(spark)


@query(f"WITH {px_sql(16)}, c AS (SELECT z, v, count(*) AS n FROM px GROUP BY z, v) SELECT z, round(-sum(n/64.0*log2(n/64.0)), 4) AS entropy FROM c GROUP BY z")
def command_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom function chosen by its name."""
    path, dims = raw_file(spark, sf_dir, "custom")
    out = reports.run_command(spark, ["-cf", "-fn", "plane_entropy", path, str(dims)], lambda line: None)
    return out.select("z", r4("entropy").alias("entropy"))


@query(f"WITH {px_sql(16)} SELECT z, CAST(sum(v) AS BIGINT) AS total FROM px WHERE z%3 = 0 GROUP BY z")
def raw_plane_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set of planes of a raw volume, of which alone the bytes are read: every third."""
    path, dims = raw_file(spark, sf_dir, "set")
    return _plane_sums(raw.read(spark, path, dims, list(range(0, dims.z, 3))))


# Streams


STREAM_EDGES = [1000, 2000, 4000, 8000, 16000]


@query(f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CAST(len(list_filter({STREAM_EDGES}, lambda b: floor(value*100) > b)) AS INTEGER) AS ix, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of codewords by day, as a stream run to its end."""
    folder = scratch(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir) if _is_file(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")
    levels = streams.windowed_levels(events, STREAM_EDGES)
    out = f"{folder}/out"
    q = levels.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "ix", "n")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile())


@query(SQ_ERRORS)
def stream_codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes coded as a stream, decoded from what the stream wrote."""
    folder, planes = scratch(spark, "stream-codec"), volume8(spark, sf_dir)
    planes.write.parquet(f"{folder}/in")
    options = QuantOptions(Dims(8, 8, depth(planes)), 3, mode=Mode.GLOBAL)
    book = counted_book(spark, sf_dir)
    stream = spark.readStream.schema(planes.schema).parquet(f"{folder}/in")
    streams.write_parquet_stream(streams.encode_planes(stream, options, book), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return _rounded_errors(metrics.plane_errors(planes, streams.decode_planes(spark.read.parquet(f"{folder}/out"), options.dims, None, 8, book)))


@query()
def stream_boxes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sq_sum, n): squared errors of all planes in boxes of four or, at the end, what is left."""
    planes = volume8(spark, sf_dir)
    book = codec.train(planes, QuantOptions(Dims(8, 8, depth(planes)), 8, Dims(4, 4, 2), Mode.GLOBAL))
    rows = planes.groupBy(F.expr("z div 4").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("z", "data"))), lambda s: s["data"])).alias("data"))
    boxes = rows.select("id", F.lit(8).alias("x"), F.lit(8).alias("y"), F.expr("size(data) div 64").cast("int").alias("z"), "data")
    back = streams.decode_boxes(streams.encode_boxes(boxes, Dims(4, 4, 2), book), Dims(4, 4, 2), book)
    both = back.select("id", F.col("data").alias("decoded")).join(rows, "id")
    off = F.zip_with("data", "decoded", lambda a, b: (a - b).cast("long"))
    return both.select("id", F.aggregate(off, F.lit(0).cast("long"), lambda s, d: s + d * d).alias("sq_sum"), F.size("decoded").cast("long").alias("n"))


# Whole reports


@query()
def codec_plane_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, encode, size and score the volume, plane by plane: 4-bit scalar codes, one codebook."""
    planes = volume8(spark, sf_dir)
    options = QuantOptions(Dims(8, 8, depth(planes)), 4, mode=Mode.GLOBAL)
    return reports.plane_report(planes, options, codec.train(planes, options))


@query()
def codec_middle_plane_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = volume8(spark, sf_dir)
    return reports.plane_report(planes, QuantOptions(Dims(16, 4, depth(planes)), 3, Dims(3, 3), Mode.MIDDLE_PLANE))


@query()
def codec_error_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = volume8(spark, sf_dir)
    return reports.error_grid(planes, Dims(8, 8, depth(planes)), list(range(2, 9)), [None, Dims(9), Dims(3, 3), Dims(3, 3, 3)], [Mode.GLOBAL, Mode.INDIVIDUAL, Mode.MIDDLE_PLANE])


@query()
def codec_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = volume8(spark, sf_dir)
    return reports.benchmark(planes, QuantOptions(Dims(8, 8, depth(planes)), 4, Dims(4, 2), Mode.GLOBAL))
