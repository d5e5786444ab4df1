"""Object versions, kept so that a batch rewrites only files that hold one of its keys.

Rows lie in files of at most ``rows_per_file`` rows in order of their keys' hashes. For
each file a batch publishes the range of its hashes and a Bloom filter: blocks of 32768
bits, a key setting four bits of one block, with a block for each 3,276 keys or fewer.
A batch of versions looks its keys up in the ranges and then in the filters, reads the
files that may hold one, and publishes them anew with the batch's rows; other files are
not read. A filter never misses a key, so a key's whole history is at hand and each
row's ``next_ts`` is final until a later batch brings the key again.
"""

from pyspark.sql import functions as F

from newsmill.functions.text import col
from newsmill.operators.lifecycle import next_in_order, plan_actions
from newsmill.sources import batches

BITS, PROBES, BITS_PER_KEY = 32768, 4, 10
# hashes that share so many first bits are one range of a look-up
SHARED = 12
ROWS_PER_FILE = 1 << 20
STATE = "modified_ts timestamp, next_ts timestamp"


def _hash(key):
    return F.xxhash64(col(key))


def _bits(h):
    """The bits of a hash in its block."""
    return F.array(*[F.pmod(F.xxhash64(h, F.lit(k)), F.lit(BITS)) for k in range(PROBES)])


def _set(bitmap, bit):
    """Whether a bit is set, in the order of the built-in bitmaps."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1


def _block(h, blocks):
    # other bits of the hash than its range and its probes use
    return F.pmod(F.xxhash64(h, F.lit(-1)), F.col(blocks))


def _describe(rows, folder):
    """Ranges and filters of freshly written files."""
    file = F.concat(F.lit(f"{folder}/rows/"), F.col("_metadata.file_name")).alias("file")
    hashes = rows.select(file, "h").distinct()
    ranges = hashes.groupBy("file").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.ceil(F.count(F.lit(1)) * F.lit(BITS_PER_KEY) / F.lit(BITS)).alias("blocks"))
    bits = hashes.join(ranges.select("file", "blocks"), "file").select("file", _block(F.col("h"), "blocks").alias("block"), F.explode(_bits(F.col("h"))).alias("bit"))
    return ranges, bits.groupBy("file", "block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


class Store:
    def __init__(self, spark, path):
        self.spark, self.path = spark, path
        self.commits = batches.committed(path)
        first = next(iter(self.commits.values()), None)
        self.types = first["types"] if first else None

    def _table(self, name, schema):
        return batches.read(self.spark, self.path, self.commits, name, schema)

    def files(self):
        """(file, low, high, blocks) of the files that count."""
        gone = self._table("gone", "file string")
        return self._table("files", "file string, low long, high long, blocks long").join(gone, "file", "left_anti")

    def holding(self, hashes):
        """Files that may hold a row with one of the hashes: by range, then by filter."""
        share = lambda h: F.shiftright(h, 64 - SHARED)
        spans = self.files().withColumn("near", F.explode(F.sequence(share(F.col("low")), share(F.col("high")))))
        asked = hashes.select("h", share(F.col("h")).alias("near"))
        met = asked.join(spans, "near").where("h >= low AND h <= high").select("file", "h", _block(F.col("h"), "blocks").alias("block"))
        tried = met.join(self._table("filters", "file string, block long, bitmap binary"), ["file", "block"])
        return tried.where(F.forall(_bits(F.col("h")), lambda b: _set(F.col("bitmap"), b))).select("file").distinct()

    def rows(self, names):
        schema = f"{self.types}, {STATE}, h long"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def all(self):
        """Every stored row; the names of the files go through the driver."""
        return self.rows([r.file for r in self.files().select("file").collect()]).drop("h")


def add(df, path, batch, rows_per_file=ROWS_PER_FILE):
    """Publish a batch of (key, version, modified_ts) rows; a batch that was published is
    not applied again. Rows without a time are not versions and are left out. One writer
    at a time. Returns the number of files that the batch has replaced."""
    spark, store = df.sparkSession, Store(df.sparkSession, path)
    if str(batch) in store.commits:
        return 0
    kinds = dict(df.dtypes)
    types = f"key {kinds['key']}, version {kinds['version']}"
    store.types = types
    new = df.where("modified_ts IS NOT NULL").select("key", "version", F.col("modified_ts").cast("timestamp"), _hash("key").alias("h"))
    asked = new.select("h").distinct()
    names = sorted(r.file for r in store.holding(asked).collect())
    old = store.rows(names).drop("next_ts")
    changed = old.join(asked, "h", "left_semi").unionByName(new)
    same = store.rows(names).join(asked, "h", "left_anti")
    again = next_in_order(changed, ["key"], "modified_ts", "version").unionByName(same)

    folder = batches.new_folder(path)
    again.select("key", "version", "modified_ts", "next_ts", "h").repartitionByRange("h", "modified_ts").sortWithinPartitions("h", "modified_ts").write.option("maxRecordsPerFile", rows_per_file).parquet(f"{folder}/rows")
    written = spark.read.schema(f"{types}, {STATE}, h long").parquet(f"{folder}/rows")
    ranges, filters = _describe(written, folder.removeprefix(f"{path}/"))
    ranges.write.parquet(f"{folder}/files")
    filters.write.parquet(f"{folder}/filters")
    spark.createDataFrame([(n,) for n in names], "file string").write.parquet(f"{folder}/gone")
    batches.commit(path, batch, folder, types=types)
    return len(names)


def latest(spark, path):
    """The current version of each key."""
    return Store(spark, path).all().where("next_ts IS NULL").drop("next_ts")


def plan(spark, path, as_of):
    """The stored versions with ``is_current``, ``next_ts`` and ``action``."""
    return plan_actions(Store(spark, path).all(), as_of, "modified_ts")
