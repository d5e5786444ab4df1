"""Token ids in binary files that are read a few documents at a time.

A file is a row of independent zstandard frames, each with its own checksum, then an
index of the documents and a seek table, both in skippable frames, so any zstandard
reader can decompress the file and ours only what a document needs.

    frame*                       up to FRAME ids, 2 bytes each (4 if the vocabulary is large)
    0x184D2A50 size index        zstd of: count, flags, ids, token counts
    0x184D2A5E size entry* footer   entry: packed size, size, crc32 of the ids' bytes
    footer                       frames (4), id width (1), 0x8F92EAB1 (4)
"""

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from newsmill.llm import arrays as A
from newsmill.llm.tokens import crc, encoder, text_groups
from newsmill.session import run_dir

FRAME = 1 << 16
INDEX, TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
MANIFEST = "part int, path string, n_docs long, n_ids long"


class Writer:
    def __init__(self, sink, width):
        self.sink, self.kind = sink, f"<u{width}"
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.entries, self.held, self.size = [], [], 0
        self.doc_ids, self.counts = [], []

    def add(self, doc_id, ids):
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= FRAME:
            rest = np.concatenate(self.held)
            while len(rest) >= FRAME:
                self.frame(rest[:FRAME])
                rest = rest[FRAME:]
            self.held, self.size = [rest], len(rest)

    def frame(self, ids):
        raw = ids.astype(self.kind).tobytes()
        packed = self.pack.compress(raw)
        self.sink.write(packed)
        self.entries.append(struct.pack("<III", len(packed), len(raw), zlib.crc32(raw)))

    def close(self):
        if self.size:
            self.frame(np.concatenate(self.held))
        known = np.array([i is not None for i in self.doc_ids], np.uint8)
        ids = np.array([i or 0 for i in self.doc_ids], "<i8")
        raw = struct.pack("<Q", len(ids)) + known.tobytes() + ids.tobytes() + np.array(self.counts, "<i8").tobytes()
        index = self.pack.compress(raw)
        self.sink.write(struct.pack("<II", INDEX, len(index)) + index)
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), int(self.kind[2]), SEEKABLE)
        self.sink.write(struct.pack("<II", TABLE, len(table)) + table)
        self.sink.close()


class Reader:
    """Documents of one file, by place; decompresses only the frames they touch."""

    def __init__(self, path):
        where, name = pa.fs.FileSystem.from_uri(path)
        self.file = where.open_input_file(name)
        end = self.file.size()
        frames, self.width, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} is not a token file")
        table = np.frombuffer(self.file.read_at(12 * frames, end - 9 - 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.upto = np.concatenate(([0], np.cumsum(table[:, 1] // self.width)))
        self.sums = table[:, 2]
        _, size = struct.unpack("<II", self.file.read_at(8, int(self.packed[-1])))
        raw = zstandard.ZstdDecompressor().decompress(self.file.read_at(size, int(self.packed[-1]) + 8))
        (n,) = struct.unpack_from("<Q", raw)
        known = np.frombuffer(raw, np.uint8, n, 8)
        self.doc_ids = [int(i) if k else None for i, k in zip(np.frombuffer(raw, "<i8", n, 8 + n), known)]
        self.counts = np.frombuffer(raw, "<i8", n, 8 + 9 * n)
        self.first = np.cumsum(self.counts) - self.counts
        self.unpack = zstandard.ZstdDecompressor()
        self.last = (None, None)

    def frame(self, k):
        if self.last[0] != k:
            packed = self.file.read_at(int(self.packed[k + 1] - self.packed[k]), int(self.packed[k]))
            raw = self.unpack.decompress(packed)
            if zlib.crc32(raw) != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, np.frombuffer(raw, f"<u{self.width}"))
        return self.last[1]

    def ids(self, place):
        lo, hi = int(self.first[place]), int(self.first[place] + self.counts[place])
        k, parts = int(np.searchsorted(self.upto, lo, "right")) - 1, []
        while lo < hi:
            base, top = int(self.upto[k]), int(self.upto[k + 1])
            parts.append(self.frame(k)[lo - base : min(hi, top) - base])
            lo, k = min(hi, top), k + 1
        return np.concatenate(parts).astype(np.uint32) if parts else np.zeros(0, np.uint32)


def write_part(tokenizer, folder, end_id, width):
    def run(batches):
        part = TaskContext.get().partitionId()
        where, base = pa.fs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"  # an attempt never touches another's file
        where.create_dir(base, recursive=True)
        out, enc = Writer(where.open_output_stream(f"{base}/{name}", compression=None), width), encoder(tokenizer)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for i, texts in text_groups(batch.column("text")):
                offs, ids = enc.encode(texts)
                for k in range(len(texts)):
                    out.add(doc_ids[i + k], np.append(ids[offs[k] : offs[k + 1]], np.uint32(end_id)))
        out.close()
        row = [[part], [f"{folder}/{name}"], [len(out.counts)], [int(sum(out.counts))]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["part", "path", "n_docs", "n_ids"])

    return run


def write_tokens(documents, tokenizer, folder=None, end_id=2, width=2, partitions=None, id_col="doc_id", text_col="text"):
    """Write the ids of every text, in ascending id order, to one file per range.

    Returns the manifest (part, path, n_docs, n_ids); ``start`` of a part is the sum
    of n_ids of the parts before. Null text is empty (its end id is still written),
    null ids come first, rows that repeat are all written, other columns are ignored.
    A lost task writes a new file; only files in the manifest count.
    """
    spark = A.ready(documents.sparkSession)
    folder = folder or run_dir(spark, "token-files")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    return A.stored(docs.mapInArrow(write_part(tokenizer, folder, end_id, width), MANIFEST), "token-manifest")


def read_part(with_ids):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                file = Reader(r["path"])
                for lo in range(0, len(file.doc_ids), 1000):
                    places = range(lo, min(lo + 1000, len(file.doc_ids)))
                    ids = [file.ids(k) for k in places]
                    columns = [
                        pa.array([file.doc_ids[k] for k in places], pa.int64()), pa.array([r["start"] + int(file.first[k]) for k in places], pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()), pa.array([crc(x) for x in ids], pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return run


def read_tokens(spark, manifest, with_ids=False):
    """Every document of the files of a manifest: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 and, ``with_ids``, ids."""
    parts = manifest.orderBy("part").collect()  # one small row per file
    rows, start = [], 0
    for p in parts:
        rows.append((p.part, p.path, start))
        start += p.n_ids
    files = spark.createDataFrame(rows, "part int, path string, start long").repartitionByRange(max(len(rows), 1), "part")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.mapInArrow(read_part(with_ids), schema)


def token_files(documents, tokenizer, **options):
    """Write the table's ids and return what a reader finds in the files."""
    return read_tokens(documents.sparkSession, write_tokens(documents, tokenizer, **options))
