"""Numpy kernels over the bytes of an Arrow batch, and small Spark helpers.

Texts are handled as one byte array per block of a few megabytes, so memory does
not follow the batch size; a document is never cut between blocks.
"""

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsmill.session import shared_dir, ship_package

U = np.uint64
TASK_ROWS = 1 << 16
_seeded = np.random.Generator(np.random.PCG64(20240601))
BYTE_CODES = _seeded.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = U(0x9E3779B97F4A7C15)
FOLDS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h):
    """Finaliser that spreads every bit of a 64-bit value."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n, base=STEP):
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = U(1)
    return np.cumprod(out)


def text_blocks(column, limit=2 << 20):
    """(first row, byte offsets of the rows, bytes) for runs of rows of about
    ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, offs[i : j + 1] - offs[i], raw[offs[i] : offs[j]]
        i = j


def words_of(offs, raw, breaks=SPACES):
    """(start, end, row) of the words of a block: maximal runs of bytes that are not
    breaks (the six ASCII white space bytes), cut at row boundaries."""
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~breaks[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < len(raw)]
    first[heads] |= inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = heads[heads > 0] - 1
    last[tails] |= inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(values, starts, ends):
    """64-bit hash of each span of a value array; spans do not overlap."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    total = int(sizes.sum())
    base = np.cumsum(sizes) - sizes
    pos = np.arange(total) - np.repeat(base, sizes)
    v = values[np.repeat(starts, sizes) + pos] * powers(int(sizes.max()))[pos]
    return mix(np.add.reduceat(v, base) + sizes.astype(np.uint64))


def word_hashes(raw, starts, ends):
    return span_hashes(BYTE_CODES[raw], starts, ends)


def gram_hashes(h, k):
    """Hashes of k consecutive items, by doubling; k is a power of two."""
    step = 1
    for fold in FOLDS:
        if step >= k:
            break
        h = h[:-step] * fold + (h[step:] ^ (h[step:] >> U(29)))
        step *= 2
    return mix(h)


def ordered_hashes(h, k):
    """Hashes of k consecutive items for any k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * STEP + h[j : j + n]
    return mix(out)


def sliding_min(h, width):
    """Minimum of every ``width`` consecutive values."""
    n, m, step = len(h) - width + 1, h, 1
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[:n], m[width - step : width - step + n])


def minimum_runs(mins, row_of, valid):
    """Maximal runs of consecutive valid windows of one row that share their
    minimum: (first window, number, minimum)."""
    n = len(mins)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    cut = np.ones(n, bool)
    cut[1:] = (mins[1:] != mins[:-1]) | (row_of[1:] != row_of[:-1]) | (valid[1:] != valid[:-1])
    at = np.flatnonzero(cut)
    sizes = np.diff(np.append(at, n))
    keep = valid[at]
    return at[keep], sizes[keep], mins[at[keep]]


def string_column(raw, starts, ends, kind=None):
    """Arrow array of byte spans, which may overlap."""
    kind = kind or pa.binary()
    sizes = (ends - starts).astype(np.int64)
    base = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=base[1:])
    pos = np.arange(int(base[-1])) - np.repeat(base[:-1], sizes)
    data = raw[np.repeat(starts, sizes) + pos]
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(data)])


def union_spans(starts, ends):
    """Disjoint spans that cover the same places as the given ones."""
    if len(starts) == 0:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(new)
    return starts[at], np.append(ends[at[1:] - 1], ends[-1])


def keyed_texts(documents, id_col="doc_id", text_col="text"):
    """(doc_id, text, key): null text is empty, key stands for the row. Rows that
    repeat id and text share a key, and so share every decision."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def masked(documents):
    """The rows under names that no helper column has, the new name of each column, and
    the way back to the old ones."""
    names = {c: f"d{k}" for k, c in enumerate(documents.columns)}
    return documents.toDF(*names.values()), names, lambda df: df.select(*names.values()).toDF(*names)


def stored(df, label, rows=None):
    """Cut the lineage: write to the shared folder and read back. Survives the
    loss of executors, unlike a cache. Where the caller knows how many ``rows`` there
    are at most, the last step has a task for each ``TASK_ROWS`` of them, or one for each
    core, instead of many with next to nothing to write."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables):
    """Delete tables of ``stored`` that nothing reads any more. What was made from them
    has to be stored by then."""
    for table in tables:
        spark = table.sparkSession
        for folder in {os.path.dirname(f) for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ready(spark):
    """What every operator with a Python step needs first."""
    ship_package(spark)
    return spark
