"""Shared helpers of the training-data operators: staged tables, let-bindings, word splitting."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_local_root: str | None = None
_staged: list[tuple[SparkSession, str]] = []
_tables: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="lamina-")
    return f"file://{_local_root}"


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/lamina-{tag}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through Hadoop's file system, so that remote paths work too."""
    if path in _tables:
        spark.sql(f"DROP TABLE IF EXISTS `{_tables.pop(path)}`")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def discard_all() -> None:
    """Delete every table between steps of this process; for long sessions, once their results have been written."""
    for spark, path in _staged:
        try:
            if spark.sparkContext._jsc is not None:
                discard(spark, path)
        except Exception:  # the session is already gone; nothing can be deleted through it
            return
    _staged.clear()


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within it, Arrow batches to Python workers have at most so many rows; for jobs that run inside, with large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged_count() -> int:
    """A mark for staged_since()."""
    return len(_staged)


def staged_since(mark: int) -> list[str]:
    """Folders made since the mark."""
    return [path for _, path in _staged[mark:]]


def discard_unread(spark: SparkSession, folders: list[str], docs: DataFrame) -> None:
    """Delete the folders that docs doesn't read."""
    read = "\n".join(docs.inputFiles())
    for path in folders:
        if path.rstrip("/").rpartition("/")[2] not in read:
            discard(spark, path)


def stage(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write df once under the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lamina_path = path
    return out


def stage_by(df: DataFrame, key: str, tag: str) -> DataFrame:
    """As stage(), bucketed by the key: joins on it find the rows where they lie and shuffle the other side alone.

    One file to a bucket, as many as shuffle partitions; the table is known to the session's catalog until it is dropped.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    path = new_folder(spark, tag)
    name = path.rpartition("/")[2].replace("-", "_")
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "snappy").format("parquet").saveAsTable(name)
    _tables[path] = name
    out = spark.table(name)
    out._lamina_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a table made by stage() or stage_by() that no later plan reads."""
    path = getattr(df, "_lamina_path", None)
    if path:
        discard(df.sparkSession, path)


def collect_garbage(spark) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """df marked for broadcast if it has at most max_rows rows (counted), else df unmarked and False."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df), True) if few else (df, False)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_groups(rows: DataFrame, table: DataFrame, keys: list[str], max_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """rows left-joined with a table that has one row per group; keys compare null-safe.

    The table is broadcast if it is counted to have at most max_rows rows; beyond that both sides are shuffled, the rows
    of every group over `salts` salts (a hot group would fill one task), the table once for each salt.
    """
    table, few = bounded_broadcast(table, max_rows)
    names = {k: f"_group_{i}" for i, k in enumerate(keys)}
    right = table.withColumnsRenamed(names)
    same = None
    if not few:
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(salts)))
        right = right.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).cast("long"))
        same = rows["_salt"] == right["_salt_of"]
    for k, name in names.items():
        test = rows[k].eqNullSafe(right[name])
        same = test if same is None else same & test
    return rows.join(right, same, "left").drop(*names.values(), "_salt", "_salt_of")


def numbered(df: DataFrame, tag: str, name: str = "_rid", codec: str = "snappy") -> DataFrame:
    """df staged with a row number that never changes again (long; not gapless)."""
    return stage(df.withColumn(name, F.monotonically_increasing_id()), tag, codec)
