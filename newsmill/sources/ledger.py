"""A ledger of keyed rows that is looked up by key and committed as a whole.

Rows lie in ``bucket=x`` folders named by the first sign of a hexadecimal key, sorted by
key; a small write makes a file per bucket, a large one a file per two signs. A write is a Python data source: every task writes one file per
bucket and reports the files with their smallest and largest key; the driver's commit
step then puts all of them into one manifest under its final name, by a rename. Only
files of a manifest are part of the ledger, so a write that was killed before its commit
left nothing, and a batch that is written again replaces its own manifest.

A look-up reads the manifests, which are small columns, and of the data only those files
whose bucket and key range meet the keys that are looked up.
"""

import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from newsmill.functions.text import col
from newsmill.session import ship_package

FORMAT, COMMITS, BUCKET = "newsmill_ledger", "_commits", "_ledger_bucket"
# signs of a key that name its folder, deal it to a task, and make one range of a look-up
DIGITS, DEALT, RANGE = 1, 2, 3
MANIFEST = pa.schema([("batch", pa.string()), ("bucket", pa.string()), ("file", pa.string()), ("low", pa.string()), ("high", pa.string()), ("n", pa.int64())])
MANIFEST_DDL = "batch string, bucket string, file string, low string, high string, n long"


def opened(path):
    """(file system, folder) of a path or URI; relative paths are not taken."""
    return pa.fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (bucket, file, low, high, n) of each file."""

    files: list


class LedgerWriter(DataSourceArrowWriter):
    def __init__(self, path, key, batch):
        self.path, self.key, self.batch = path, key, batch

    def write(self, iterator):
        """Rows come sorted by bucket and key; one file per bucket. A retried task writes
        files of its own, so what a lost one left is in no manifest."""
        where, base = opened(self.path)
        files, bucket, out = [], None, None
        for rows in iterator:
            names = rows.column(BUCKET).to_pylist()
            keys = rows.column(self.key)
            body = rows.drop_columns([BUCKET])
            start = 0
            for k in range(1, len(names) + 1):
                if k < len(names) and names[k] == names[start]:
                    continue
                if names[start] != bucket:
                    if out:
                        out.close()
                    bucket = names[start]
                    where.create_dir(f"{base}/bucket={bucket}", recursive=True)
                    files.append([bucket, f"bucket={bucket}/{uuid.uuid4().hex}.parquet", keys[start].as_py(), None, 0])
                    out = pq.ParquetWriter(f"{base}/{files[-1][1]}", body.schema, filesystem=where)
                out.write_batch(body.slice(start, k - start))
                files[-1][3], files[-1][4] = keys[k - 1].as_py(), files[-1][4] + k - start
                start = k
        if out:
            out.close()
        return Written([tuple(f) for f in files])

    def commit(self, messages):
        """All files of the write, or none: the manifest appears under its name at once."""
        where, base = opened(self.path)
        rows = [(self.batch, *f) for m in messages if m for f in m.files]
        table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(MANIFEST), MANIFEST)], schema=MANIFEST)
        where.create_dir(f"{base}/{COMMITS}", recursive=True)
        unnamed = f"{base}/{COMMITS}/.{uuid.uuid4().hex}"
        pq.write_table(table, unnamed, filesystem=where)
        where.move(unnamed, f"{base}/{COMMITS}/{self.batch}.parquet")

    def abort(self, messages):
        where, base = opened(self.path)
        for m in messages:
            for f in m.files if m else ():
                where.delete_file(f"{base}/{f[1]}")


class LedgerSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def writer(self, schema, overwrite):
        return LedgerWriter(self.options["path"], self.options["key"], self.options["batch"])


def bucket_of(key):
    return F.substring(col(key), 1, DIGITS)


def append(df, path, key, batch=None):
    """Add rows with unique string keys in hexadecimal as one commit. ``batch`` names it:
    writing it again replaces what it wrote before; without a name it is a new one."""
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(LedgerSource)
    rows = df.withColumn(BUCKET, bucket_of(key)).repartition(F.substring(key, 1, DEALT)).sortWithinPartitions(BUCKET, key)
    batch = f"batch-{batch}" if batch is not None else f"once-{uuid.uuid4().hex}"
    rows.write.format(FORMAT).option("path", path).option("key", key).option("batch", batch).mode("append").save()


def manifest(spark, path):
    """The committed files, one row each; empty where nothing was committed."""
    where, base = opened(path)
    info = where.get_file_info(f"{base}/{COMMITS}")
    if info.type == pa.fs.FileType.NotFound:
        return spark.createDataFrame([], MANIFEST_DDL)
    return spark.read.schema(MANIFEST_DDL).parquet(f"{path}/{COMMITS}")


def without_batch(files, batch):
    return files if batch is None else files.where(F.col("batch") != f"batch-{batch}")


def touched(files, keys, key):
    """The files that may hold one of the keys: by bucket, and by the smallest and largest
    of the keys that share RANGE signs; a file meets 256 such ranges at most."""
    ranges = keys.groupBy(bucket_of(key).alias("bucket"), F.substring(key, 1, RANGE)).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    return files.join(ranges, "bucket").where("low <= last AND high >= first").select("file").distinct()


def read(spark, path, files, schema):
    """Rows of some committed files, given as rows of the manifest. The names of the files
    that a call touches go through the driver, their rows do not."""
    names = [f"{path}/{r.file}" for r in files.select("file").distinct().collect()]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*names)


def look_up(df, path, key, schema, batch=None):
    """Rows of the ledger that share a key with ``df``, but for those of one batch."""
    spark = df.sparkSession
    files = without_batch(manifest(spark, path), batch)
    if files.isEmpty():  # nothing to look up; ``df`` is not worked out
        return spark.createDataFrame([], schema)
    files = touched(files, df.select(key), key)
    return read(spark, path, files, schema).join(df.select(key).distinct(), key, "left_semi")


def rows(spark, path, schema):
    """All committed rows."""
    return read(spark, path, manifest(spark, path), schema)
