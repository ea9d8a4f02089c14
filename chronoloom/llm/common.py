"""What several operators share: words, tables in the shared folder, prefix sums, rows that may hold some keys."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# White space of every word rule here: space, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"
LEAST_RANGES, MOST_RANGES = 256, 1 << 16
RANGE_BYTES = 1 << 25
BATCH_ROWS = 1000
BITMAP_BITS, MOST_BITMAP_BITS = 20, 28  # 2**28 bits are 32 MB
BITMAP_ROW = 1 << 15  # bits of one row of a bitmap, as bitmap_construct_agg has them


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_column(docs: DataFrame, key: str = "doc_id") -> tuple[Column, str]:
    """A table's ids and the name of their type: integers as long, ids of any other type as they are."""
    kind = docs.schema[key].dataType
    whole = isinstance(kind, (T.IntegralType, T.NullType))
    return (F.col(key).cast("long").alias(key), "bigint") if whole else (F.col(key), kind.simpleString())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset, one in the warehouse.

    Executors on other machines can't reach a warehouse on the driver's disk, so that is an error.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return path
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if reaches_one_machine(spark.sparkContext.master, _file_system(spark, path)[0].getUri().getScheme()):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path


def reaches_one_machine(master: str, scheme: str | None) -> bool:
    """True where a folder of this scheme is on the driver's disk alone and executors are elsewhere."""
    return scheme in (None, "file") and not master.startswith("local")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def scratch_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is deleted when the driver ends."""
    folder = f"{shared_folder(spark)}/chronoloom-{spark.sparkContext.applicationId}"
    files, path = _file_system(spark, folder)
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate results that nothing reads any more."""
    files, path = _file_system(spark, folder)
    files.delete(path, True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Computes df once, as a table in the scratch folder; the table as a DataFrame, and its folder."""
    folder = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage; see written()."""
    return written(df)[0]


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is computed inside goes to Python in Arrow batches of at most BATCH_ROWS rows, as its rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def position(bounds: Column, value: Column, log2_size: int) -> Column:
    """How many of the ascending `bounds` (under 2**log2_size of them) are <= value."""
    steps = F.array(*[F.lit(2**k) for k in reversed(range(log2_size))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda pos, step: F.when(F.get(bounds, pos + step - 1) <= value, pos + step).otherwise(pos),
    )


def literal_array(values: list, kind: str) -> Column:
    """A constant array of numbers; as one literal, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def n_ranges(n_bytes: int) -> int:
    """Ranges of about RANGE_BYTES, a power of two; beyond MOST_RANGES of them, ranges grow."""
    return min(MOST_RANGES, max(LEAST_RANGES, 1 << (max(1, n_bytes // RANGE_BYTES) - 1).bit_length()))


def with_range(df: DataFrame, key: str, name: str, ties: list[str] = (), n_bytes: int = 0) -> DataFrame:
    """Adds the number of the row's range (long): ascending in the key, with about equally many rows each.

    The bounds are approximate quantiles of the numeric key, one range for each RANGE_BYTES of the `n_bytes` that the rows have.
    A key that is several quantiles, that is a hot one, gets as many ranges, dealt by a hash of `ties`; null keys, which come
    first, likewise. So a range is too large only where very many rows agree in key and ties.
    """
    count = n_ranges(n_bytes)
    quantiles = literal_array([i / count for i in range(1, count)], "double")
    bounds_of = F.call_function("percentile_approx", F.col(key), quantiles, F.lit(max(20000, 4 * count)))
    found = df.agg(bounds_of.alias("bounds"), F.count("*").alias("n"), F.count(key).alias("known")).first()
    bounds = found["bounds"] or []
    nulls = 1 + (count * (found["n"] - found["known"])) // max(1, found["n"])
    tie = F.xxhash64(*[F.col(t) for t in ties]) if ties else F.lit(0)
    place = F.lit(0)
    if bounds:
        kind, times = df.schema[key].dataType.simpleString(), Counter(bounds)
        single = sorted(times)
        at = position(literal_array(single, kind), F.col(key), len(single).bit_length())
        last = F.get(literal_array([0, *accumulate(times[b] for b in single)], "int"), at)
        # rows of a repeated bound go to any of its places, those of larger keys to the last one
        hot = F.when(F.get(literal_array(single, kind), at - 1) == F.col(key), F.get(literal_array([1, *(times[b] for b in single)], "int"), at)).otherwise(1)
        place = last - F.pmod(tie, hot)
    return df.withColumn(name, F.when(F.col(key).isNull(), F.pmod(tie, F.lit(nulls)) - nulls).otherwise(place).cast("long"))


def prefix_sums(df: DataFrame, key: str, ties: list[str], sums: dict[str, Column], group: list[str], n_bytes: int = 0) -> DataFrame:
    """Adds, for each name of `sums`, the sum over the rows that come before, within `group`.

    Rows are in the order of the key (null first), then of their range (see with_range), then of ties. Totals for each key range
    come first; a running sum inside a range then starts at the sum of the ranges before it. No task gets more than one range of
    one group, however many rows the group has. Rows that agree in key and ties must agree in what is summed. `df` is read three
    times and must give the same rows each time. Columns of `group` must not be null.
    """
    ranged = with_range(df, key, "_range", ties, n_bytes)
    by = [*group, "_range"]
    totals = ranged.groupBy(*by).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, *[F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in sums])
    if not group:
        starts = F.broadcast(starts)  # one row for each range, so at most 2 * MOST_RANGES
    inside = Window.partitionBy(*by).orderBy(F.asc_nulls_first(key), *ties).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()])
    out = running.join(starts, by)
    return out.select(*df.columns, *[(F.col(f"_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums])


def running_sums(values: Column) -> Column:
    """Of an array of ints, the sums of the elements before each; one more element at the end has the whole sum.

    The array is cut into chunks of about the root of its size and each is summed by itself, as every appending copies an array.
    """
    none = F.array().cast("array<bigint>")
    first = F.struct(F.lit(0).cast("long").alias("at"), none.alias("before"))

    def summed(part: Column) -> Column:
        return F.aggregate(part, first, lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.array_append(acc["before"], acc["at"]).alias("before")))

    def chunks(all_: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(all_).cast("double"))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / size).cast("int")), lambda i: summed(F.slice(all_, i * size + 1, size)))

    def starts(parts: Column) -> Column:
        return F.aggregate(parts, first, lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.array_append(acc["before"], acc["at"]).alias("before")))

    def joined(parts: Column, start: Column) -> Column:
        return F.concat(F.flatten(F.zip_with(parts, start["before"], lambda p, at: F.transform(p["before"], lambda b: b + at))), F.array(start["at"]))

    # transform() binds the values, their chunks and the chunks' starts, each once
    parts_of = F.transform(F.array(values), chunks)
    return F.transform(parts_of, lambda parts: F.transform(F.array(starts(parts)), lambda start: joined(parts, start))[0])[0]


def may_be_among(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """Adds the boolean `name`, which is true wherever the key is among `keys` (one column), and seldom elsewhere.

    Native bitmaps of hashed keys: about 64 bits a key, at most 2**MOST_BITMAP_BITS (32 MB), which bounds what is broadcast.
    So rows that cannot match stay out of a shuffle. A null key is a key like others.
    """
    n = keys.count()
    bits = min(MOST_BITMAP_BITS, max(BITMAP_BITS, (64 * n).bit_length()))
    slot = lambda k: F.pmod(F.xxhash64(k), F.lit(2**bits))
    held = keys.select(slot(F.col(keys.columns[0])).alias("_slot")).groupBy(F.floor(F.col("_slot") / BITMAP_ROW).alias("_row_of"))
    held = held.agg(F.bitmap_construct_agg(F.col("_slot") % BITMAP_ROW).alias("_bits"))
    own = slot(key)
    probe = df.withColumn("_row_of", F.floor(own / BITMAP_ROW)).join(F.broadcast(held), "_row_of", "left")
    at = own % BITMAP_ROW
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return probe.withColumn(name, hit).drop("_row_of", "_bits")
