"""Shared helpers of the subpackage: reading tables, scratch tables, text expressions."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.shipping import ship_package

#: The characters that separate words: blank and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster must set it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="terrace-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared scratch folder: cuts lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def collect_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner find the shuffles and broadcasts that nothing reads any more, and delete their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, name: str, *keys: str) -> tuple[DataFrame, str]:
    """df as a scratch table dealt out by the keys, so that joins on them need not shuffle it again; and the table's name, to drop it by."""
    spark, name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(shuffle_partitions(spark), *keys).option("path", scratch_path(spark, name)).saveAsTable(name)
    return spark.table(name), name


def drop_bucketed(spark: SparkSession, name: str) -> None:
    drop_written(spark.table(name))
    spark.sql(f"DROP TABLE {name}")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column_or(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or nulls of that type where the table has none."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


#: Items that scan() takes one by one; longer arrays are cut into blocks of this many.
SCAN_BLOCK = 128


def scan(items: Column, zero: Column, step, emit, kind: str) -> Column:
    """array<kind> of emit(state, item), the state being zero folded by step over the items before it.

    Appending to an array copies it, so the items are cut into blocks: the states at the
    blocks' beginnings come first, then each block by itself, and the work stays about
    linear up to millions of items.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(state: Column, block: Column) -> Column:
        both = lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.array_append(acc["out"], emit(acc["s"], x)).alias("out"))
        return F.aggregate(block, F.struct(state.alias("s"), none.alias("out")), both, lambda acc: acc["out"])

    def run(blocks: Column) -> Column:
        states = F.aggregate(blocks, F.array(zero), lambda out, block: F.array_append(out, F.aggregate(block, F.element_at(out, -1), step)))
        return F.flatten(F.zip_with(F.slice(states, 1, F.size(blocks)), blocks, one))

    return let(items, lambda x: F.when(F.size(x) == 0, none).when(F.size(x) <= SCAN_BLOCK, one(zero, x)).otherwise(let(blocks_of(x, SCAN_BLOCK), run)))


def blocks_of(items: Column, size: int) -> Column:
    """The array, which has an item at least, cut into arrays of `size` items, the last one shorter."""
    last = F.floor((F.size(items) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * size + 1, size))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Those names, each with as many underscores before it as no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; empty where there is none."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def remainder_of_id(modulus: int, name: str = "doc_id") -> Column:
    """crc32(id as text) mod modulus; null ids count as remainder 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % modulus, F.lit(0).cast("bigint"))
