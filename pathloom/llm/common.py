"""What the operators share: reading tables, durable intermediate tables, Arrow helpers."""

from __future__ import annotations

import contextvars
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.durable import shared_dir

#: Bytes of text that a Python worker turns into one output batch.
SLICE_BYTES = 2 << 20
#: An intermediate table of a compact operator has a file for so many bytes of the operator's input at most, or so many for each core.
FILE_BYTES, FILES_PER_CORE = 24 << 20, 2
#: Bytes that a writer of such a file gathers before it writes a row group.
ROW_GROUP = 8 << 20
#: Bytes that a Python worker is sent at once, and the setting for it.
BATCH_BYTES, BATCH_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


class Workspace:
    """What a running compact operator has made (tables in the shared folder), and into how many files a table goes at most."""

    def __init__(self, spark: SparkSession, inputs: list[DataFrame]):
        # Catalyst's estimate; of a join it is far too high, which leaves the files to the adaptive coalescing of partitions
        size = max((int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for df in inputs), default=0)
        self.files = min(max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES)), 1 << 30)
        self.made: list[DataFrame] = []


#: Of this thread's innermost compact operator.
_workspace: contextvars.ContextVar[Workspace | None] = contextvars.ContextVar("workspace", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, scanned: bool = False) -> DataFrame:
    """df written to the shared folder as Parquet and read again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and what follows sees plain columns with statistics. The schema is kept as it is.
    scanned: df comes from a scan whose tasks are large; else, in a compact operator, tasks are joined so
    that many shuffle partitions don't become as many small files. How many grows with the input.
    """
    spark, own = df.sparkSession, _workspace.get()
    if own and not scanned:
        df = df.coalesce(own.files)
    path = f"{shared_dir(spark)}/pathloom-{uuid.uuid4().hex}/{label}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if own:
        release(spark)
        own.made.append(out)
    return out


def compact(operator: Callable) -> Callable:
    """An operator whose result (a DataFrame, or a named tuple of them) is a table, and whose intermediate tables are removed once it is, or once it fails."""

    @functools.wraps(operator)
    def run(*args, **options):  # noqa: ANN002, ANN003, ANN202
        inputs = [x for x in (*args, *options.values()) if isinstance(x, DataFrame)]
        spark, outer = inputs[0].sparkSession, _workspace.get()
        batch = spark.conf.get(BATCH_KEY)
        own = Workspace(spark, inputs)
        token = _workspace.set(own)
        try:
            out = operator(*args, **options)
            parts = [materialise(df, "result") for df in ([out] if isinstance(out, DataFrame) else out)]
            del own.made[-len(parts) :]
        finally:
            _workspace.reset(token)
            discard(*own.made)
            spark.conf.set(BATCH_KEY, batch)
        if outer:
            outer.made += parts
        return parts[0] if isinstance(out, DataFrame) else type(out)(*parts)

    return run


def release(spark: SparkSession) -> None:
    """Spark removes the shuffle files of finished stages when the driver's garbage is collected; have that now, since the tables just written replace them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialise() from the shared folder once what was made of them is a table itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def utf8_bytes(text: str | Column) -> Column:
    """Bytes of a text in UTF-8; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128 bits by which equal texts are found; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one, `_row`, so that others can stand beside them under any name."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")


def held_out(doc_id: str | Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], of: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text column `of` of each holds about `most` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(of)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def bounded_batches(df: DataFrame, most: int = BATCH_BYTES) -> None:
    """Have the session send Python workers batches of at most `most` bytes (a longer row alone), whatever the rows' size; a smaller setting stays."""
    conf, key = df.sparkSession.conf, BATCH_KEY
    held = df.sparkSession.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key))
    if held <= 0 or held > most:
        conf.set(key, f"{most}b")
