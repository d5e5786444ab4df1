"""Connected components of a link table."""

from pyspark.sql import functions as F

from newsmill.llm.arrays import dropped, stored


def components(links, x="x", y="y"):
    """(v, root): the smallest member of each vertex's component, for every vertex
    that is not the smallest itself. Large and small stars by turns (Kiveris et al.):
    no neighbour list is gathered, a hub is a join key that may be split, and the
    number of rounds grows with the logarithm of the longest path."""
    edges = links.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u > v").distinct()
    edges, before = stored(edges, "links"), None
    rows = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        last, edges = edges, stored(small.select("e.*").where("u > v").distinct(), "links", rows)
        dropped(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before, rows = now, now[0]
