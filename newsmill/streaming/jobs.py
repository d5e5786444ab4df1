"""Exactly-once ingest, de-duplication, windowed rates and delivery on streams."""

from pyspark.sql import functions as F

from newsmill.functions.text import col
from newsmill.operators.messages import message_sink
from newsmill.session import run_dir
from newsmill.sources.events import raw_object_decode

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def object_stream(spark, path, max_files=1000, glob=None):
    """Every new object below ``path`` as a stream; the source needs its schema."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def table_stream(spark, folder, name, max_files=100):
    """A Parquet table (a file, a folder of parts, or a pattern) as a stream, with the
    schema of what is there already."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    # the source wants a folder or a pattern, so a single file is named by a pattern
    path = f"{folder}/{name[:-1]}[{name[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(stream, out, label="stream", mode="append"):
    """Run a stream over all that is available and stop; ``out`` receives the rows.

    Source offsets and sink commits live in the checkpoint below ``out``, so a
    second run with the same ``out`` only handles new input.
    """
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/_state_{label}").option("path", f"{out}/rows")
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")


def stream_ingest(spark, source, out=None, content="content"):
    """Each object of a stream exactly once, decoded to text with its reject reason."""
    out = out or run_dir(spark, "ingest")
    return run_available(raw_object_decode(source, content).drop(content), out, "ingest")


def land_batches(stream, out, label, shape):
    """Every micro-batch of a stream, shaped, in a folder of its own, which a replay
    overwrites; returns all of them. No watermark, so no row is ever too late."""
    spark, path = stream.sparkSession, f"{out}/{label}"
    empty = shape(spark.createDataFrame([], stream.schema))
    empty.write.mode("overwrite").parquet(f"{path}/batch=-1")
    write = lambda batch, batch_id: shape(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/_state_{label}")
    query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(empty.schema).parquet(path).select(*empty.columns)


def stream_dedup(spark, source, ids=("id",), ts="ts", out=None):
    """Each id once although reads overlap: the earliest row, whatever the number and
    the order of the files. Batches are reduced before they are written."""
    ids, rest = list(ids), [c for c in source.columns if c not in ids]

    def first(df):
        order = F.struct(ts, *[c for c in rest if c != ts])
        return df.groupBy(*ids).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*ids, "r.*").select(*source.columns)

    return first(land_batches(source, out or run_dir(spark, "dedup"), "dedup", first))


def stream_rate_windows(spark, source, ts="ts", period="1 hour", out=None):
    """Events per tumbling period, equal to the batch result: each batch writes its
    counts per period, and the counts are added up."""

    def counts(df):
        window = F.window(col(ts).cast("timestamp"), period)["start"].alias("period_start")
        return df.groupBy(window).agg(F.count(F.lit(1)).alias("n"))

    landed = land_batches(source, out or run_dir(spark, "rates"), "rates", counts)
    return landed.groupBy("period_start").agg(F.sum("n").alias("n"))


def stream_messages(source, path, checkpoint, sender=None):
    """Deliver a stream of messages; a replayed batch replaces its own rows."""
    write = lambda batch, batch_id: message_sink(batch, path, batch_id, sender)
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
