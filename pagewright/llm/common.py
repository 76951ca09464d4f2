"""Session and column helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .words import give_back

#: One separator run between words: space and the ASCII controls 9 to 13.
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
#: Bytes of an Arrow batch, from the JVM to a Python worker.
BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session gets one of its own; a cluster must set it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not found:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="pagewright-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
        current = sc._jsc.sc().getCheckpointDir()
    return found or current.get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: computed once, safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it is removed when this process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def laid_down(df: DataFrame) -> DataFrame:
    """As cut, but as a Parquet table: smaller where rows are many and short."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and broadcasts of plans that are done with: it does so when the driver's garbage goes."""
    gc.collect()
    give_back()
    jvm = spark.sparkContext._jvm
    for _ in range(2):  # objects that Python has let go of are let go of in the JVM with the next call
        jvm.System.gc()


def in_arrow(df: DataFrame, emit, schema) -> DataFrame:
    """df.mapInArrow(emit, schema) with batches bounded by bytes, unless the session has a bound of its own: whole texts vary by
    orders of magnitude, and a batch stands in the memory of the JVM and of its worker at once."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES_KEY, None) is None:
        conf.set(BATCH_BYTES_KEY, BATCH_BYTES)
    names = df.columns
    if not any(c in name for name in names for c in ".`"):
        return df.mapInArrow(emit, schema)
    # mapInArrow takes such names for nested fields; they are put aside and back
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(kinds)])

    def renamed(batches):
        for out in emit(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=plain.names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, plain).toDF(*kinds.names)


def words_of(text: Column) -> Column:
    """All words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), "")


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their literal names, whatever these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free_names(taken: list[str], *names: str) -> dict[str, str]:
    """For each name one that no column has, in whatever case."""
    used = {c.lower() for c in taken}
    out = {}
    for name in names:
        free = f"__{name}"
        while free.lower() in used:
            free += "_"
        used.add(free.lower())
        out[name] = free
    return out


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text leaves that remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def label_of(labels: DataFrame, column: str, modulus: int, remainder: int) -> DataFrame:
    """(doc_id, label double) of the rows that may be learnt from; repeated ids are averaged."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    return rows.groupBy("doc_id").agg(F.avg("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents, those with the least hash of their id.

    The bound is what makes the broadcast safe: the sample's ids and labels are 16 bytes a row."""
    ids = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    ids = ids.select(F.col("doc_id").alias("sample_id"), "label")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("sample_id")).select("doc_id", "text", "label")
