"""Values by period, kept so that quantiles of any span need few of them.

A batch holds three tables. ``values``: distinct values of a (period, group) with their
counts, ordered by (period, group, value) and cut into files of at most ``rows_per_file``
rows, so that a file is a short run of values and one row group. ``blocks``: for each
file and (period, group) in it the smallest and largest value and the number of rows.
``sketches``: a mergeable KLL sketch of each (period, group) and its size.

A question merges the sketches of its span, takes from each group cuts around the wanted
ranks, counts the blocks below the cuts by their sizes, and reads only files with a block
that meets the cuts. The cuts come from a sketch and may miss a rank; exact counts tell,
and for such a rank alone the cut on the missed side is opened. Results are exact.
"""

from pyspark.sql import functions as F

from newsmill.functions.frames import join_on
from newsmill.functions.text import col
from newsmill.operators.quantiles import pick_ranks
from newsmill.session import run_dir
from newsmill.sources import batches

# size of a sketch, and by how much of the group its cuts lie beside a wanted rank:
# about 1.5 times the sketch's usual error of a rank
K, SLACK = 800, 0.008
ROWS_PER_FILE = 1 << 20


def _types(df, by):
    kinds = dict(df.dtypes)
    return "".join(f", `{c}` {kinds[c]}" for c in by)


def add(df, path, batch, by, value, ts="ts", period="1 day", rows_per_file=ROWS_PER_FILE):
    """Publish a batch of rows. Rows without a value or time hold nothing to rank. The
    batch's name replaces what was published under it; other batches stay."""
    by = list(by)
    data = df.select(F.window(col(ts).cast("timestamp"), period)["start"].alias("period"), *by, col(value).cast("double").alias("v"))
    data = data.where("period IS NOT NULL AND v IS NOT NULL")
    keys, folder = ["period", *by], batches.new_folder(path)
    counted = data.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c"))
    runs = counted.repartitionByRange(*keys, "v").sortWithinPartitions(*keys, "v")
    runs.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{folder}/values")
    sketch = F.kll_sketch_agg_double("v", F.lit(K)).alias("sketch")
    data.groupBy(*keys).agg(sketch, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/sketches")
    schema = f"period timestamp{_types(df, by)}, v double, c long"
    written = df.sparkSession.read.schema(schema).parquet(f"{folder}/values")
    file = F.concat(F.lit(f"{folder.removeprefix(f'{path}/')}/values/"), F.col("_metadata.file_name")).alias("file")
    written.groupBy(file, *keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("c").alias("n")).write.parquet(f"{folder}/blocks")
    batches.commit(path, batch, folder, by=by, types=_types(df, by))


class Span:
    """The stored values of the periods in [first, last)."""

    def __init__(self, spark, path, first=None, last=None):
        self.spark, self.path = spark, path
        self.commits = batches.committed(path)
        if not self.commits:
            raise ValueError(f"no batch was published in {path}")
        fact = next(iter(self.commits.values()))
        self.by, self.types = fact["by"], fact["types"]
        edge = lambda t: F.lit(t).cast("timestamp")
        self.in_span = (F.col("period") >= edge(first) if first else F.lit(True)) & (F.col("period") < edge(last) if last else F.lit(True))

    def table(self, name, columns):
        return batches.read(self.spark, self.path, self.commits, name, f"period timestamp{self.types}, {columns}").where(self.in_span)

    def bounds(self, quantiles):
        """(group, name, n, p, low, high): the rank of each quantile and cuts around it;
        a null cut is open."""
        sketches = self.table("sketches", "sketch binary, n long").groupBy(*self.by)
        merged = sketches.agg(F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"), F.sum("n").alias("n"))
        merged = merged.where("n > 0").withColumn("known", F.kll_sketch_get_n_double("sketch"))
        # ends are open; a group of values that a sketch does not take has no cuts
        cut = lambda at: F.when(F.col("known") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(at))) if 0 < at < 1 else F.lit(None).cast("double")
        one = lambda name, q: F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(float(q))).alias("p"), cut(q - SLACK).alias("low"), cut(q + SLACK).alias("high"))
        return merged.select(*self.by, "n", F.inline(F.array(*[one(*item) for item in quantiles.items()])))

    def meeting(self, bounds):
        """Blocks under a bound of their group, or meeting it."""
        blocks = self.table("blocks", "file string, low double, high double, n long")
        blocks = blocks.withColumnsRenamed({"low": "first", "high": "last", "n": "size"})
        under = F.col("low").isNotNull() & (F.col("last") < F.col("low"))
        placed = join_on(blocks, bounds, self.by).withColumn("under", under)
        return placed.where(F.col("under") | F.col("high").isNull() | (F.col("first") <= F.col("high")))

    def files(self, bounds):
        """Files with a value that may lie inside a bound."""
        return self.meeting(bounds).where("NOT under").select("file").distinct()

    def inside(self, bounds):
        """(counted values up to their bounds, exact ranks of the bounds).

        The rank of a cut is the values under it in the files that are read, and the
        blocks under it in all others, so each value counts once. The names of the files
        go through the driver, their rows do not."""
        keys, files = [*self.by, "name"], self.files(bounds)
        names = [f"{self.path}/{r.file}" for r in files.collect()]
        schema = f"period timestamp{self.types}, v double, c long"
        values = self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)
        values = values.where(self.in_span).groupBy(*self.by, "v").agg(F.sum("c").alias("c"))
        met = join_on(values, bounds, self.by).where("high IS NULL OR v <= high").withColumn("under", F.coalesce(F.col("v") < F.col("low"), F.lit(False)))
        whole = self.meeting(bounds).where("under").join(files, "file", "left_anti").groupBy(*keys).agg(F.sum("size").alias("whole"))
        counts = met.groupBy(*keys).agg(F.sum(F.when(F.col("under"), F.col("c"))).alias("part"), F.sum(F.when(~F.col("under"), F.col("c"))).alias("size"))
        ranks = join_on(join_on(bounds, counts, keys, "left"), whole, keys, "left").na.fill(0, ["part", "whole", "size"])
        return met.where("NOT under").select(*keys, "v", "c"), ranks.withColumn("before", F.col("part") + F.col("whole")).drop("part", "whole")


def opened(ranks):
    """The bounds again, without the cuts that missed a rank."""
    early, late = F.floor("p") < F.col("before"), F.ceil("p") >= F.col("before") + F.col("size")
    return ranks.withColumns({"low": F.when(~early, F.col("low")), "high": F.when(~late, F.col("high")), "missed": early | late}).drop("before", "size")


def pinned(df):
    """The same rows from a table in the shared folder. Merging sketches takes random
    choices, so cuts that are worked out twice may differ."""
    path = run_dir(df.sparkSession, "history-bounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_quantiles(spark, path, quantiles, first=None, last=None):
    """One row per group of the periods in [first, last): group columns and a double for
    each of ``{name: q}``. A second look is taken only if a cut has missed a rank."""
    span = Span(spark, path, first, last)
    keys = [*span.by, "name"]
    bounds = pinned(span.bounds(quantiles))
    values, ranks = span.inside(bounds)
    again = pinned(opened(ranks))
    if again.where("missed").limit(1).count():
        values, ranks = span.inside(again.drop("missed"))
    counted = join_on(values.withColumnsRenamed({"v": "_v", "c": "_c"}), ranks.select(*keys, "p", F.col("before").alias("_before")), keys)
    found = pick_ranks(counted.withColumn("_b", F.lit(0)), keys, {"value": F.col("p")})
    at = [F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in quantiles]
    return found.groupBy(*span.by).agg(*at)
