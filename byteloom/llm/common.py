"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of one key that one task may get before ``join_split`` deals them out, and how many keys it deals out at most.
SPLIT_ROWS, SPLIT_KEYS = 4096, 4096
#: Rows of a part that is numbered alone, at least, and parts for each shuffle partition, about.
PART_ROWS, PARTS_A_TASK = 100, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local session may do without."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or (sc.getCheckpointDir() or "")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="byteloom-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to the shared folder. For loops: a checkpoint hands on the estimated sizes of all the joins before
    it, whose digits double with each round; what is read from files has its own size."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.held = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((found, path))
        return found

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables but these."""
        for found, path in self.held:
            if not any(found is t for t in tables):
                delete(self.spark, path)
        self.held = [(found, path) for found, path in self.held if any(found is t for t in tables)]


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def hashable(df: DataFrame) -> list[Column]:
    """All columns in forms that have a hash, which maps have not."""
    return [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]


def batch_input(df: DataFrame, names: list[str], column: str) -> tuple[DataFrame, int]:
    """The columns kept and, at the place returned, a string column to work on; one that is kept isn't sent twice."""
    if column in names and df.schema[column].dataType.simpleString() == "string":
        return df.select(*names), names.index(column)
    return df.select(*names, F.col(column).cast("string").alias(fresh(df, "_input")[0])), len(names)


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def join_split(many: DataFrame, one: DataFrame, on: str, spread: Column, how: str = "inner") -> DataFrame:
    """``many`` joined to ``one``, which has a row for each value of ``on``; no task gets all rows of a hot value.

    Values with more than SPLIT_ROWS rows in ``many`` are dealt out over as many parts by the hash of ``spread``, and
    their row of ``one`` is copied to each part. The SPLIT_KEYS most frequent values are treated so, and no more are ever
    broadcast: any other value has less than a SPLIT_KEYS-th of all rows. ``many`` is read twice, so it should be cheap.
    """
    digest, parts, salt = fresh(many.join(one, on), "_digest", "_parts", "_salt")
    counted = many.groupBy(F.xxhash64(on).alias(digest)).agg(F.count(F.lit(1)).alias(parts)).where(F.col(parts) > SPLIT_ROWS)
    hot = counted.orderBy(F.desc(parts), digest).limit(SPLIT_KEYS).select(digest, F.ceil(F.col(parts) / SPLIT_ROWS).cast("int").alias(parts))

    def marked(df: DataFrame) -> DataFrame:
        found = df.withColumn(digest, F.xxhash64(on)).join(F.broadcast(hot), digest, "left").drop(digest)
        return found.withColumn(parts, F.coalesce(parts, F.lit(1)))

    left = marked(many).withColumn(salt, F.pmod(F.xxhash64(spread), F.col(parts)).cast("int")).drop(parts)
    right = marked(one).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col(parts) - 1))).drop(parts)
    return left.join(right, [on, salt], how).drop(salt)


def part_rows(spark: SparkSession, total: int) -> int:
    """How many rows of a key ``salted_rank`` should number together.

    A few parts for each shuffle partition even the tasks out, and keep the number of parts, whose counts are summed up,
    in proportion to the partitions instead of the rows.
    """
    return max(PART_ROWS, total // (PARTS_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def salted_rank(df: DataFrame, keys: list[str], salt: str, order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based rank of each row within ``keys``, ordered by ``salt`` and then ``order``.

    ``salt`` splits each key into parts of bounded size, so no task ever sorts a whole hot key: rows are counted
    by (key, salt), a running sum over those few counts says where each part starts, and each part is numbered
    alone. The counts are joined on the columns that the numbering has already dealt the rows by.
    """
    part = [*keys, salt]
    count, start, at = fresh(df, "_count", "_start", "_at")
    before = F.sum(count).over(W.partitionBy(*keys).orderBy(salt).rowsBetween(W.unboundedPreceding, -1))
    starts = df.groupBy(*part).agg(F.count(F.lit(1)).alias(count)).select(*part, F.coalesce(before, F.lit(0)).alias(start))
    numbered = df.withColumn(at, F.row_number().over(W.partitionBy(*part).orderBy(*order)) - 1)
    return numbered.join(starts, part).withColumn(name, F.col(start) + F.col(at)).drop(start, at)
