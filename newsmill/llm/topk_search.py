"""Exact search for the highest inner products by a pivot-distance index.

Vectors are whole numbers, floor(scale * x). With one more coordinate,
sqrt(R^2 - |x|^2), all candidates have the norm R, and a higher inner product is a
smaller distance: D(q, x)^2 = R^2 + |q|^2 - 2 <q, x>. A vector's key is its nearest
pivot and its distance to it; rows sorted by this key are cut into annuli, one packed
row each. A query first searches the annuli of its nearest pivot; the distance of its
k-th best so far then says, by the triangle inequality |D(q,p) - D(x,p)| <= D(q,x),
which annuli of which pivots can still hold a better one. Bounds are widened by more
than rounding errors, so the result is exact, ties included.

Queries are searched in blocks; pivots come from a bounded sample and only steer.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from newsmill.llm import arrays as A

PIVOTS, ANNULUS, QUERY_BLOCK = 64, 1024, 256
PACKED = "block long, pivot int, low double, high double, ids array<long>, vectors binary"
LEAST = -(2**62)


def whole_vectors(table, id_col="vec_id", vector_col="embedding", scale=1024):
    """(id, v): usable vectors as whole numbers; of rows with one id the smallest."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return table.where(usable).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def padded(column, width):
    """Rows of a list column as one array, short ones with zeros."""
    values, offs = column.values.to_numpy(), column.offsets.to_numpy().astype(np.int64)
    out, sizes = np.zeros((len(column), width), np.int64), np.diff(offs)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(int(sizes.sum())) - np.repeat(offs[:-1] - offs[0], sizes)] = values[offs[0] : offs[-1]]
    return out


def lifted(v, top):
    """The extra coordinate that gives all candidates one norm."""
    return np.sqrt(np.maximum(top - (v.astype(np.float64) ** 2).sum(1), 0))


def distances(v, extra, pivots, pivot_extra):
    """Distances of lifted vectors to lifted pivots."""
    a, b = np.column_stack((v.astype(np.float64), extra)), np.column_stack((pivots.astype(np.float64), pivot_extra))
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def key_rows(pivots, top, width):
    extra = lifted(pivots, top)

    def run(batches):
        for batch in batches:
            v = padded(batch.column("v"), width)
            if not len(v):
                continue
            d = distances(v, lifted(v, top), pivots, extra)
            near = d.argmin(1)
            packed = A.string_column(np.ascontiguousarray(v).view(np.uint8).ravel(), np.arange(len(v)) * 8 * width, np.arange(1, len(v) + 1) * 8 * width)
            columns = [batch.column("id"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(v)), near]), packed]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "pivot", "d", "vector"])

    return run


def pack_rows(size):
    """Sorted keyed rows -> one row per annulus (or query block)."""

    def run(batches):
        held = []

        def flush():
            ids = np.array([r[0] for r in held], np.int64)
            name = int(A.mix(A.mix(ids[:1].view(np.uint64)) + A.U(held[0][1]))[0] >> A.U(1))
            row = (name, held[0][1], held[0][2], held[-1][2], ids.tolist(), b"".join(r[3] for r in held))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary()))], names=["block", "pivot", "low", "high", "ids", "vectors"])

        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("id", "pivot", "d", "vector")]):
                if held and (len(held) >= size or held[0][1] != r[1]):
                    yield flush()
                    held = []
                held.append(r)
        if held:
            yield flush()

    return run


def unpack(ids, vectors, width):
    return np.array(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(-1, width)


def reach(pivots, top, width):
    """For each query block and pivot, the distances that can still matter: between
    the lowest D(q,p) - D_k and the highest D(q,p) + D_k of its queries."""
    extra = lifted(pivots, top)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                _, q = unpack(r["ids"], r["vectors"], width)
                best = np.frombuffer(r["best"], np.int64).astype(np.float64)
                norm = (q.astype(np.float64) ** 2).sum(1)
                d = distances(q, np.zeros(len(q)), pivots, extra)
                radius = np.sqrt(np.maximum(top + norm - 2 * best, 0)) * (1 + 1e-9) + 1e-3
                radius[best <= LEAST] = np.inf
                slack = 1e-3 + d.max() * 1e-6
                low, high = (d - radius[:, None]).min(0) - slack, (d + radius[:, None]).max(0) + slack
                n = len(low)
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(low), pa.array(high)], names=["query_block", "pivot", "from", "to"])

    return run


def search(k, width):
    """The k best of one annulus for each query of a block."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, q = unpack(r["q_ids"], r["q_vectors"], width)
                ids, v = unpack(r["ids"], r["vectors"], width)
                exact = np.abs(q).max() * float(np.abs(v).max()) * width < 2**52
                score = (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64) if exact else q @ v.T
                order = np.argsort(ids)
                ids, score = ids[order], score[:, order]
                top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
                query, score, found = np.repeat(q_ids, top.shape[1]), np.take_along_axis(score, top, 1).ravel(), ids[top].ravel()
                keep = query != found
                yield pa.RecordBatch.from_arrays([pa.array(query[keep]), pa.array(found[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

    return run


def best_of(found, k):
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk_search(table, every=100, k=10, scale=1024, id_col="vec_id", vector_col="embedding"):
    """For each row whose id is divisible by ``every`` the k highest integer inner
    products with other rows: query_id, rank, vec_id, score; ties to the smaller id.

    Null vectors, vectors with null, NaN or infinite components, empty ones and rows
    without an id take no part; of rows with one id the smallest vector counts; shorter
    vectors count as padded with zeros; other columns are ignored; fewer than k others
    give fewer rows; an empty table gives none.
    """
    spark = A.ready(table.sparkSession)
    rows = A.stored(whole_vectors(table, id_col, vector_col, scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e)
    size = rows.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("top")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if size.width is None:
        return spark.createDataFrame([], schema)
    width, top = size.width, float(size.top)
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()  # the documented sample
    pivots = np.array([list(r.v) + [0] * (width - len(r.v)) for r in chosen], np.int64)
    keyed = rows.mapInArrow(key_rows(pivots, top, width), "id long, pivot int, d double, vector binary")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["pivot", "d", "id"]
    index = A.stored(keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(pack_rows(ANNULUS), PACKED), "annuli")
    asked = keyed.where(F.col("id") % every == 0)
    queries = A.stored(asked.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(pack_rows(QUERY_BLOCK), PACKED), "query-blocks")
    asking = queries.select(F.col("block").alias("query_block"), "pivot", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    found_schema = "query_id long, vec_id long, score long"

    near = asking.join(index.select("pivot", "ids", "vectors"), "pivot").select("q_ids", "q_vectors", "ids", "vectors").mapInArrow(search(k, width), found_schema)
    first = best_of(near, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(LEAST)).alias("best"))
    first = A.stored(first, "first-bounds")

    # the bounds, in the order of each block's queries
    listed = queries.select("block", F.posexplode("ids").alias("place", "query_id")).join(first, "query_id", "left")
    bounds = listed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("best", F.lit(LEAST)).alias("best")))).alias("b"))
    told = queries.join(bounds.select("block", F.transform("b", lambda x: x["best"]).alias("bests")), "block")
    told = told.select("block", "ids", "vectors", "bests").mapInArrow(with_bounds, "block long, ids array<long>, vectors binary, best binary")
    spans = told.mapInArrow(reach(pivots, top, width), "query_block long, pivot int, `from` double, `to` double")
    pairs = spans.join(index.select("pivot", "block", "low", "high"), "pivot").where("high >= `from` AND low <= `to`").select("query_block", "block")
    work = pairs.join(asking.drop("pivot"), "query_block").join(index.select("block", "ids", "vectors"), "block").select("q_ids", "q_vectors", "ids", "vectors")
    return best_of(work.mapInArrow(search(k, width), found_schema), k).select("query_id", "rank", "vec_id", "score")


def with_bounds(batches):
    for batch in batches:
        best = [np.array(b, np.int64).tobytes() for b in batch.column("bests").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("ids"), batch.column("vectors"), pa.array(best, pa.binary())], names=["block", "ids", "vectors", "best"])
