"""Stored objects as a stream that follows notifications instead of listing folders.

A notification log is a folder of numbered batches of (bucket, key), each a Parquet table
that counts once its ``_SUCCESS`` file is there; one writer appends to it. The source's
offset is the number of the last batch read. A partition is a run of notification rows of
one file: an executor reads those rows and then the objects they name, so neither keys
nor contents pass through the driver, and a restart reads only what came later.

A notification may come twice, so the ingest records every object once, by its key, in a
ledger whose look-up touches the buckets of the new keys only.
"""

import datetime
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.storagelevel import StorageLevel

from newsmill.session import run_dir, ship_package
from newsmill.sources import ledger
from newsmill.sources.events import raw_object_decode

FORMAT = "newsmill_objects"
OBJECT = "bucket string, key string, modificationTime timestamp, length long, content binary"
TAKEN = "object_id string, bucket string, key string, length long, text string, reject_reason string"
ROWS, BYTES = 256, 8 << 20


def batches_of(where, base):
    """Numbers of the complete batches up to the first that is not."""
    if where.get_file_info(base).type == pa.fs.FileType.NotFound:
        return []
    found = sorted(int(f.base_name) for f in where.get_file_info(pa.fs.FileSelector(base)) if f.base_name.isdigit())
    out = []
    for n in found:
        if where.get_file_info(f"{base}/{n:012d}/_SUCCESS").type == pa.fs.FileType.NotFound:
            break
        out.append(n)
    return out


def announce(records, path):
    """Append notifications (bucket, key) to the log; a batch that a killed writer left
    unfinished is written over."""
    where, base = ledger.opened(path)
    done = batches_of(where, base)
    records.select("bucket", "key").write.mode("overwrite").parquet(f"{path}/{done[-1] + 1 if done else 0:012d}")


@dataclass
class Notifications(InputPartition):
    file: str
    first: int
    n: int


class NotifiedReader(DataSourceStreamReader):
    def __init__(self, log, root, rows):
        self.log, self.root, self.rows = log, root, rows

    def initialOffset(self):
        return {"batch": -1}

    def latestOffset(self):
        done = batches_of(*ledger.opened(self.log))
        return {"batch": done[-1] if done else -1}

    def partitions(self, start, end):
        where, base = ledger.opened(self.log)
        out = []
        for n in range(start["batch"] + 1, end["batch"] + 1):
            files = where.get_file_info(pa.fs.FileSelector(f"{base}/{n:012d}"))
            for f in sorted(f.path for f in files if f.path.endswith(".parquet")):
                total = pq.read_metadata(f, filesystem=where).num_rows
                out += [Notifications(f, i, min(self.rows, total - i)) for i in range(0, total, self.rows)]
        return out

    def read(self, partition):
        where, _ = ledger.opened(self.log)
        store, base = ledger.opened(self.root)
        rows = pq.read_table(partition.file, columns=["bucket", "key"], filesystem=where).slice(partition.first, partition.n)
        held, size = [], 0
        for row in rows.to_pylist():
            held.append((row["bucket"], row["key"], *self.object(store, f"{base}/{row['bucket']}/{row['key']}")))
            size += held[-1][3] or 0
            if size > BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    @staticmethod
    def object(store, path):
        """(time, length, content); nulls where the object is gone."""
        info = store.get_file_info(path)
        if info.type != pa.fs.FileType.File:
            return None, None, None
        with store.open_input_stream(path, compression=None) as file:
            content = file.read()
        return info.mtime or datetime.datetime.fromtimestamp(0, datetime.UTC), len(content), content

    def commit(self, end):
        pass


def packed(rows):
    kinds = [pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "key", "modificationTime", "length", "content"])


class NotifiedObjects(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return OBJECT

    def streamReader(self, schema):
        return NotifiedReader(self.options["log"], self.options["root"], int(self.options.get("rows", ROWS)))


def notified_objects(spark, log, root, rows=ROWS):
    """The objects below ``root`` that the log names, as a stream: bucket, key,
    modificationTime, length, content (the last three null where one is gone)."""
    ship_package(spark)
    spark.dataSource.register(NotifiedObjects)
    return spark.readStream.format(FORMAT).option("log", log).option("root", root).option("rows", rows).load()


def ingest_notified(spark, log, root, out=None):
    """Every notified object once, decoded: bucket, key, length, text, reject_reason
    (``missing`` where it is gone). A run takes what came since the last one with the
    same ``out``; a batch that is run again replaces what it recorded."""
    out = out or run_dir(spark, "objects")

    def record(batch, batch_id):
        rows = raw_object_decode(batch).withColumn("object_id", F.sha2(F.concat_ws("/", "bucket", "key"), 256))
        reason = F.when(F.col("content").isNull(), "missing").otherwise(F.col("reject_reason"))
        rows = rows.withColumn("reject_reason", reason).dropDuplicates(["object_id"])
        rows = rows.select("object_id", "bucket", "key", "length", "text", "reject_reason").persist(StorageLevel.DISK_ONLY)
        known = ledger.look_up(rows, f"{out}/objects", "object_id", TAKEN, batch_id)
        ledger.append(rows.join(known.select("object_id"), "object_id", "left_anti"), f"{out}/objects", "object_id", batch_id)
        rows.unpersist()

    query = notified_objects(spark, log, root).writeStream.foreachBatch(record).option("checkpointLocation", f"{out}/_state")
    query.trigger(availableNow=True).start().awaitTermination()
    return ledger.rows(spark, f"{out}/objects", TAKEN).drop("object_id")


def store_objects(df, root):
    """Write each row (bucket, key, content) as an object below ``root``; returns the
    notifications of what was written. A retried task writes the same objects again."""

    def run(batches):
        store, base = ledger.opened(root)
        for batch in batches:
            for row in batch.to_pylist():
                path = f"{base}/{row['bucket']}/{row['key']}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path, compression=None) as file:
                    file.write(row["content"])
            yield batch.select(["bucket", "key"])

    ship_package(df.sparkSession)
    return df.select("bucket", "key", "content").mapInArrow(run, "bucket string, key string")
