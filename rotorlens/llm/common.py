"""Helpers shared by the training-data operators: paths, durable intermediate tables, small SQL bits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and TAB, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of bitmaps (4 KB each, for up to 32,768 rows of a file) that are sent to every executor; beyond it, a shuffle.
BROADCAST_BITMAPS = 16_000
#: Ends the life of an execution's shuffle files with the execution; no frame that stored() writes runs twice.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a Python worker gets at a time; texts are long.
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/rotorlens-scratch").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    _scratch.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


@contextmanager
def conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, instead_of: Iterable[DataFrame] = ()) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a reread of files and not a recomputation. The
    files stay until tidied() or the cluster clears them, since the returned frame is lazy; those of
    stored frames that nobody reads any more, `instead_of`, go at once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with conf(spark, {TIDY: "true", ROWS: "1000"}):
        # The frame is analysed anew, so that it runs under the setting above.
        df.select("*").write.parquet(path)
    for old in instead_of:
        drop(old)
    return spark.read.schema(df.schema).parquet(path)


def small(stored_rows: DataFrame, most: int = 500_000) -> DataFrame:
    """Stored rows of a few numbers each, to be sent to every executor if they are `most` or fewer; beyond it, joins shuffle."""
    return F.broadcast(stored_rows) if stored_rows.count() <= most else stored_rows


def drop(frame: DataFrame) -> None:
    """Delete the files of a frame that stored() returned."""
    files = frame.inputFiles()
    if files:
        drop_path(frame.sparkSession, files[0].rsplit("/", 1)[0])


@contextmanager
def tidied(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Deletes what has been stored inside, but for the frames that are put into keep."""
    first = len(_scratch)
    yield
    kept = {f.inputFiles()[0].rsplit("/", 2)[1] for f in keep if f.inputFiles()}
    for path in _scratch[first:]:
        if path.rsplit("/", 1)[1] not in kept:
            drop_path(spark, path)
    del _scratch[first:]


def folder_of(docs: DataFrame) -> str | None:
    """The folder of Parquet files that docs reads whole, if it is such a plain scan."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return None
    files = docs.inputFiles()
    folders = {f.rsplit("/", 1)[0] for f in files}
    if len(folders) != 1:
        return None
    folder = folders.pop()
    named = docs.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(docs.sparkSession.sparkContext._jvm.java.net.URI(folder)).toString()
    try:
        whole = docs.sparkSession.read.schema(docs.schema).parquet(named)
    except AnalysisException:
        return None
    return named if len(whole.inputFiles()) == len(files) else None


def on_file(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs as a plain scan, so that _metadata names each row's file and place, and its folder."""
    folder = folder_of(docs)
    if folder is None:
        folder = fresh_path(docs.sparkSession, name)
        with conf(docs.sparkSession, {TIDY: "true"}):
            docs.select("*").write.parquet(folder)
    return docs.sparkSession.read.schema(docs.schema).parquet(folder), folder


def _by_row(scan: DataFrame, named: DataFrame, inside: bool) -> DataFrame:
    """The rows of a plain scan that `named` names by file and row, or all others.

    Named rows travel as bitmaps, a bit for each row of a file that has any, so that texts need not be
    shuffled to meet them.
    """
    at = {"bucket": F.bitmap_bucket_number("row"), "bit": F.bitmap_bit_position("row")}
    bitmaps = stored(named.withColumns(at).groupBy(F.col("file").alias("__rl_file"), F.col("bucket").alias("__rl_bucket")).agg(F.bitmap_construct_agg("bit").alias("__rl_bits")), "named-rows")
    row = F.col("_metadata.row_index")
    marked = scan.select("*", F.col("_metadata.file_path").alias("__rl_at"), F.bitmap_bucket_number(row).alias("__rl_part"), F.bitmap_bit_position(row).alias("__rl_bit"))
    few = bitmaps.count() <= BROADCAST_BITMAPS
    same = (F.col("__rl_at") == F.col("__rl_file")) & (F.col("__rl_part") == F.col("__rl_bucket"))
    met = marked.join(F.broadcast(bitmaps) if few else bitmaps, same, "inner" if inside else "left")
    byte = F.conv(F.hex(F.expr("substring(__rl_bits, cast(__rl_bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = F.col("__rl_bits").isNotNull() & (F.getbit(byte, F.col("__rl_bit") % 8) == 1)
    return met.where(hit if inside else ~hit).select(*scan.columns)


def without_rows(scan: DataFrame, dropped: DataFrame) -> DataFrame:
    return _by_row(scan, dropped, inside=False)


def only_rows(scan: DataFrame, picked: DataFrame) -> DataFrame:
    return _by_row(scan, picked, inside=True)


def lean(run: Callable) -> Callable:
    """A worker's function that gives its free memory back when it is done: workers live on, and the next stage needs room."""

    def wrapped(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def rested(spark: SparkSession) -> None:
    """Executors collect their garbage and give free heap back, which Python workers of the next stage need."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; lower() is the same, and faster, on pure ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
