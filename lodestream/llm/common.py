"""What the corpus operators share: words, table access and durable cuts of lineage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same class for Java's regular expressions.
SPACE_SQL = r"[\x20\x09-\x0D]+"
#: A-Z to a-z and nothing else: no other letter changes, so word bounds and lengths stay.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Rows of whole texts that a worker takes at once: some texts are megabytes long.
TEXT_BATCH = 400
#: Rows for which gathered() makes a file.
FILE_ROWS = 1 << 15


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder. One whose files make fewer tasks than there are cores is dealt out
    first, as what is done to a text takes far longer than moving it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def ready(spark: SparkSession) -> None:
    """A checkpoint folder: the cluster's own, or on a single machine a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestream-"))


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise in the shared checkpoint folder: what follows survives the loss of executors. rows: a
    bound on the number of rows, if one is known, for gathered()."""
    ready(df.sparkSession)
    return (df if rows is None else gathered(df, rows)).checkpoint(eager=True)


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """The same, dealt to a task a core or FILE_ROWS rows, if that is a tenth of the shuffle partitions or
    fewer. Each file that is made on a local file system has the executor start up to four processes
    (chmod, for it and its checksum), and until such a process runs it counts the executor's memory again."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))
    return df.repartition(parts) if 10 * parts <= int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def written(df: DataFrame) -> DataFrame:
    """The same as a Parquet table in the shared checkpoint folder, which is smaller on disk. It
    stays until dropped() or the end of the driver."""
    spark = df.sparkSession
    ready(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/lodestream-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestream_path = path
    if not _tables:
        atexit.register(_drop_tables)
    _tables[path] = spark
    return out


_tables: dict[str, SparkSession] = {}


def dropped(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing reads any more."""
    for df in tables:
        path = df._lodestream_path
        spark = _tables.pop(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def released(df: DataFrame) -> None:
    """Has the driver see now which shuffles nothing refers to any more, so that their files go. It would
    do so at its next collection, which may be many small steps away; nothing that is in use is touched."""
    df.sparkSession._jvm.System.gc()


def _drop_tables() -> None:
    for path, spark in list(_tables.items()):
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that others can't clash; a column that is missing counts as null."""
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string"}
    return df.select(*[(F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in names])


def map_texts(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in steps of TEXT_BATCH rows (Spark bounds a batch's bytes), in a worker that gives
    memory back: two of them share an executor with a JVM."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, max(batch.num_rows, 1), TEXT_BATCH):
                yield batch.slice(lo, TEXT_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(steps(batches))
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can trim
        ctypes.CDLL(None).malloc_trim(0)


def fold(key: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo: the folds that the contracts fix. A null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(stem: str) -> str:
    """A column name that no input has."""
    return f"__{stem}_{uuid.uuid4().hex[:8]}"
