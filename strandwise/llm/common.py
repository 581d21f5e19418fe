"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the characters between words: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def ascii_folded(col: Column) -> Column:
    """A string that is equal for two texts exactly if they are equal once A-Z are lower-cased; for hashing, not for display.

    translate() walks a map per character, so the bytes are read as Latin-1 and lower-cased instead. That also moves the first
    byte of a two-byte character by 0x20, which stays reversible: the number of continuation bytes tells it apart.
    """
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.lower(F.decode(F.encode(col, "UTF-8"), "ISO-8859-1")))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body refers to it (lambdas would evaluate it per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A session without the setting gets a temporary folder only if it runs in one process (local mode), where there is nothing
    to share it with; on a cluster it is an error, as executors would write to disks of their own.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="strandwise-")
        shared_dir.own = place
    return place


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and survive lost executors.

    A result is lazy and reads its tables when it is used, so they stay for the life of the application, whose end deletes the
    whole folder; drop() removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark).rstrip('/')}/strandwise-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        fs, path = self._at(self.base)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.base}/{len(self.paths) + 1}"
        self.paths.append(path)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for path in paths:
            fs, target = self._at(path)
            fs.delete(target, True)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def below(key: Column, share: float) -> Column:
    """True for about that share of the rows, by a hash of key that is the same in every run. A sample taken with it costs one
    scan: no rows are sorted and none move that aren't in it."""
    return F.pmod(F.xxhash64(key, F.lit(41)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def salted_join(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, hot: int = 512, salts: int = 64) -> DataFrame:
    """Inner equi-join where a few keys may hold a large part of left's rows.

    right has one row per key and the number of left's rows for it in `weight`. Its `hot` heaviest keys (that many rows at
    most, so small enough to broadcast) are copied to `salts` salts, and left's rows of these keys are dealt over the salts by
    `spread`; any other key holds less than 1/hot of left's rows.
    """
    heavy = F.broadcast(right.orderBy(F.desc(weight), key).limit(hot).select(key, F.lit(True).alias("__hot")))
    is_hot = F.coalesce("__hot", F.lit(False))
    salt_left = F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    salts_right = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(heavy, key, "left").withColumn("__salt", salt_left).drop("__hot")
    b = right.join(heavy, key, "left").withColumn("__salt", F.explode(salts_right)).drop("__hot")
    return a.join(b, [key, "__salt"]).drop("__salt")
