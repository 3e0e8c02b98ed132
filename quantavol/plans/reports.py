"""The commands: compress, decompress, train, inspect, benchmark, custom functions, and their reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantavol.operators import codec, metrics, scalar, tiling, vector, volume
from quantavol.operators.huffman import HuffmanCode
from quantavol.options import CODEBOOK_SUFFIX, CONTAINER_SUFFIX, Dims, Method, Mode, OptionError, QuantOptions
from quantavol.sources import codebooks, container, memory, raw

Listener = Callable[[str], None]


def _silent(message: str) -> None:
    pass


def shared_book(planes: DataFrame, options: QuantOptions, say: Listener = _silent) -> codec.Codebook | None:
    """The codebook of the options' mode: none of its own, the middle plane's, or the stored (else trained) one."""
    if options.mode is Mode.INDIVIDUAL:
        return None
    spark = planes.sparkSession
    if options.mode is Mode.GLOBAL and options.store:

        def train() -> codec.Codebook:
            say(f"no codebook of {options.train_name} in {options.store}: training")
            return codec.train(planes, options)

        return codebooks.load_or_train(spark, options.store, options.train_name, options.codebook_size, options.tile, train)
    return codec.train(planes, options)


#: Inputs that are images, with dimensions of their own; all others are raw volumes or containers.
IMAGE_SUFFIXES = (".tif", ".tiff", ".pgm")


def open_input(spark: SparkSession, options: QuantOptions) -> DataFrame:
    """The planes of an input by its kind: images, a container, or a raw volume of the given dimensions."""
    path = options.path.lower()
    if path.endswith(IMAGE_SUFFIXES):
        planes, options.dims = memory.volume_of_images(memory.from_images(spark, options.path))
        return planes
    if path.endswith(CONTAINER_SUFFIX.lower()):
        return open_container(spark, options.path)
    return raw.read(spark, options.path, options.dims)


def compress_file(spark: SparkSession, options: QuantOptions, say: Listener = _silent) -> container.Header:
    """A raw volume or images into a container; the planes of raw volumes are read where they are coded."""
    if not options.path.lower().endswith(IMAGE_SUFFIXES):
        options.validate()
        training = raw.read(spark, options.path, options.dims, options.training_planes())
        book = shared_book(training, options, say)
        chunks = codec.compress_raw(spark, options, book)
    else:
        planes, options.dims = memory.volume_of_images(memory.from_images(spark, options.path))
        options.validate()
        book = shared_book(planes, options, say)
        chunks = codec.compress(planes, options, book)
    head = container.Header.of_options(options)
    container.write_container(chunks, options.output, head, book)
    say(f"{options.path}: {head.chunks} chunks")
    return container.read_header(options.output)


def decompress_file(spark: SparkSession, path: str, output: str, say: Listener = _silent) -> DataFrame:
    """A container into a raw volume; gives the planes too."""
    planes = open_container(spark, path)
    raw.register(spark)
    planes.write.format("u16raw").mode("append").save(output)
    say(f"{path} -> {output}")
    return planes


def open_container(spark: SparkSession, path: str) -> DataFrame:
    """The planes of a container, decoded when they are used."""
    chunks, head, book = container.read_container(spark, path)
    return codec.decompress(chunks, head.dims, head.tile, head.k, book)


def train_and_save(planes: DataFrame, options: QuantOptions) -> codec.Codebook:
    book = codec.train(planes, options)
    codebooks.save(planes.sparkSession, options.store, options.train_name, book)
    return book


def train_and_save_all(planes: DataFrame, options: QuantOptions) -> list[codec.Codebook]:
    """Codebooks of 2, 4 .. 256 codewords: vectors from one run; scalars each from the one histogram."""
    rows = volume.training_rows(planes, options)
    if options.tile is None:
        counts = scalar.counts_of(rows)
        books: list[codec.Codebook] = [scalar.train_counts(counts, 1 << b, options.init).codebook for b in range(1, 9)]
    else:
        a, b = options.training_planes()
        vecs = tiling.tiles(rows, Dims(options.dims.x, options.dims.y, b - a + 1), options.tile, options.wrap, a)
        books = list(vector.train_all_sizes(vecs, options.tile, 256, options.seed))
    for book in books:
        codebooks.save(planes.sparkSession, options.store, options.train_name, book)
    return books


def inspect(spark: SparkSession, path: str, verbose: bool = False) -> str:
    """What a container or a codebook file holds, and whether it is whole."""
    if path.endswith(CODEBOOK_SUFFIX):
        name, book = codebooks.import_file(path)
        return codebooks.describe(name, book, verbose)
    try:
        head = container.read_header(path)
    except OptionError as e:
        return f"{e}\nvalid: no"
    size, pixels = container.files.size_of(path), head.dims.count
    found = head.problems()
    whole = not found and size == head.size + head.body_size
    lines = [
        f"header: {'valid' if not found else ', '.join(found)}",
        f"kind: {head.kind.name.lower()}",
        f"bits: {head.bits} ({head.k} codewords)",
        f"codebook: {'one for each plane' if head.book_each else 'one for all'}",
        f"volume: {head.dims}",
        f"tile: {head.tile or 'none'}",
        f"file: {size} bytes, header {head.size}, body {size - head.size} ({'as expected' if whole else f'expected {head.body_size}'})",
        f"ratio: {size / (2 * pixels):.4f}",
        f"bits a pixel: {8 * size / pixels:.4f}",
    ]
    if verbose:
        unit = "layer" if head.tile and head.tile.z > 1 else "plane"
        lines += [f"{unit} {i}: {n} bytes" for i, n in enumerate(head.sizes)]
    return "\n".join([*lines, f"valid: {'yes' if whole else 'no'}"])


def inspect_frame(chunks: DataFrame, head: container.Header) -> DataFrame:
    """(chunk, n_bytes, offset, bpp) of a container's chunks."""
    pixels = head.dims.count / head.chunks
    return metrics.chunk_offsets(chunks.select("chunk", "n_bytes"), head.size).withColumn("bpp", F.col("n_bytes") * 8 / F.lit(pixels))


def roundtrip(planes: DataFrame, options: QuantOptions, book: codec.Codebook | None = None) -> DataFrame:
    """(z, abs_sum, mae, mse, psnr, n) after coding and decoding the selected planes."""
    options.validate()
    book = book or shared_book(planes, options)
    chunks = codec.compress(planes, options, book)
    first = options.selected()[0]
    dims = Dims(options.dims.x, options.dims.y, options.plane_count)
    decoded = codec.decompress(chunks, dims, options.tile, options.codebook_size, book, first)
    return metrics.plane_errors(volume.select(planes, options), decoded)


def plane_report(planes: DataFrame, options: QuantOptions, book: codec.Codebook | None = None) -> DataFrame:
    """(z, entropy, n_bytes, bpp, mse, psnr, mae) of each plane, for chunks that are planes."""
    book = book or shared_book(planes, options)
    first = options.selected()[0]
    coded = codec.compress(planes, options, book).select((F.col("chunk") + first).alias("z"), "n_bytes")
    px = volume.select(planes, options)
    h = metrics.entropy(metrics.plane_histogram(px), "z").drop("n")
    return h.join(coded, "z").join(roundtrip(planes, options, book), "z").select("z", "entropy", "n_bytes", (F.col("n_bytes") * 8.0 / options.dims.plane).alias("bpp"), "mse", "psnr", "mae")


def error_grid(planes: DataFrame, dims: Dims, bits: list[int], tiles: list[Dims | None], modes: list[Mode], seed: int = 1) -> DataFrame:
    """roundtrip() over all combinations that exist: (tile, mode, bits, z, abs_sum, mae, mse, psnr, n).

    Planes are read once for each tile, not for each combination, and aren't joined.
    """
    out = []
    for tile in tiles:
        chosen = [m for m in modes if not (tile and tile.z > 1) or m is Mode.GLOBAL]
        if chosen and bits:
            o = QuantOptions(dims, bits[0], tile, chosen[0], seed=seed)
            o.validate()
            out.append(codec.grid_sums(planes, o, bits, chosen))
    mse = F.col("sq_sum") / F.col("n")
    return metrics.union(out).select("tile", "mode", "bits", "z", "abs_sum", (F.col("abs_sum") / F.col("n")).alias("mae"), mse.alias("mse"), metrics.psnr(mse).alias("psnr"), "n")


def benchmark(planes: DataFrame, options: QuantOptions) -> DataFrame:
    """Errors of a round trip over all selected planes together."""
    e = roundtrip(planes, options)
    n, a = F.sum("n"), F.sum("abs_sum")
    mse = F.sum(F.col("mse") * F.col("n")) / n
    return e.agg((a / n).alias("mae"), mse.alias("mse")).withColumn("psnr", metrics.psnr(F.col("mse")))


# Custom functions: DataFrame in, DataFrame out, by name.

FUNCTIONS: dict[str, Callable[..., DataFrame]] = {}


def custom(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    FUNCTIONS[f.__name__] = f
    return f


@custom
def plane_entropy(planes: DataFrame) -> DataFrame:
    return metrics.entropy(metrics.plane_histogram(planes), "z")


@custom
def plane_difference(planes: DataFrame, other: DataFrame) -> DataFrame:
    """(z, diff, abs_diff) of two volumes."""
    d = metrics.difference(planes, other)
    return d.select("z", F.col("data").alias("diff"), F.transform("data", F.abs).alias("abs_diff"))


@custom
def plane_error(planes: DataFrame, other: DataFrame) -> DataFrame:
    return metrics.plane_errors(planes, other)


@custom
def differences_in_folder(planes: DataFrame, folder: str, plane: int, dims: Dims) -> DataFrame:
    """(file, diff, abs_diff) of one plane against that plane of every raw volume of a folder."""
    spark = planes.sparkSession
    out = []
    for name in raw.files.names_in(folder, ".raw"):
        other = raw.read(spark, f"{folder}/{name}", dims, (plane, plane))
        pair = plane_difference(volume.select_planes(planes, plane), volume.select_planes(other, plane))
        out.append(pair.select(F.lit(name).alias("file"), "diff", "abs_diff"))
    return metrics.union(out)


def write_csv(df: DataFrame, path: str, decimals: int = 4) -> None:
    """A report as CSV with `;` and a header, doubles with so many decimals."""
    columns = [F.format_string(f"%.{decimals}f", F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    df.select(*columns).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def write_train_log(spark: SparkSession, log: list[tuple[int, float, float]], path: str) -> None:
    rows = scalar.log_frame(spark, log).select(F.col("iteration").alias("It"), F.col("mse").alias("MSE"), F.col("psnr").alias("PSNR"))
    write_csv(rows.coalesce(1), path)


def write_codewords(spark: SparkSession, book: codec.Codebook, path: str) -> None:
    """Codewords as text, one a line."""
    words = book.vectors.tolist() if isinstance(book, vector.VectorCodebook) else [[c] for c in book.centroids.tolist()]
    spark.createDataFrame([(" ".join(map(str, w)),) for w in words], "value string").coalesce(1).write.mode("overwrite").text(path)


def coded_bits(planes: DataFrame, book: scalar.ScalarCodebook, spark: SparkSession) -> DataFrame:
    """(z, bits, n_bytes) of scalar coding, from counts of codewords, without packing."""
    ix = scalar.encode_planes(planes, book).select("z", F.explode("data").alias("ix"))
    n = ix.groupBy("z", "ix").agg(F.count(F.lit(1)).alias("n"))
    return metrics_total(n, HuffmanCode(book.frequencies).frame(spark))


def metrics_total(counts: DataFrame, code: DataFrame) -> DataFrame:
    from quantavol.operators.huffman import total_bits

    return total_bits(counts, code, "z")


def run_command(spark: SparkSession, argv: list[str], say: Listener = print) -> object:
    """A command line: see QuantOptions.from_args."""
    o = QuantOptions.from_args(argv)
    if o.problems:
        raise OptionError("; ".join(o.problems))
    planes = lambda: open_input(spark, o)
    match o.method:
        case Method.COMPRESS:
            return compress_file(spark, o, say)
        case Method.DECOMPRESS:
            return decompress_file(spark, o.path, o.output, say)
        case Method.TRAIN:
            return train_and_save(planes(), o)
        case Method.INSPECT:
            say(inspect(spark, o.path, o.verbose))
        case Method.BENCHMARK:
            return benchmark(planes(), o)
        case Method.CUSTOM:
            if o.function not in FUNCTIONS:
                raise OptionError(f"no custom function {o.function}; there are {', '.join(sorted(FUNCTIONS))}")
            return FUNCTIONS[o.function](planes())
        case Method.HELP:
            say(QuantOptions.from_args.__doc__)
    return None
