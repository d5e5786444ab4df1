"""Mix sources to target weights with exact block quotas per output shard.

A source is cut into ``BLOCKS`` blocks by a hash of its rows. A mix takes some whole
passes over a source, and in a last pass as many blocks (then parts of one block,
then rows) as its target wants. The taken blocks are dealt to output shards by a
splitting tree: a node halves its shards, and the blocks of each source that go left
are a draw without replacement from all its blocks (multivariate hypergeometric);
which blocks they are follows from a permutation, so shards are disjoint. Rows are
shuffled inside their shard by a hash.

Only DataFrame functions; every size is summed per block before sources meet.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsmill.llm.arrays import masked, stored

BLOCKS = 256
WEIGHTS = (5, 2, 1)
REPEATS = 3
SHARDS = 16
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    """Words of a text without building their list: white space is collapsed, then
    blanks are counted."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    inner = F.trim(flat)
    return F.when(inner == "", F.lit(0)).otherwise(F.length(inner) - F.length(F.translate(inner, " ", "")) + 1).cast("long")


def uniform(*columns):
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def source_targets(sizes, weights=WEIGHTS, repeats=REPEATS):
    """(source, source_size) -> target and what it means in passes.

    The whole size is shared by weight; a source gets at most ``repeats`` times its
    size and the rest goes to the others by weight. Sorted by size over weight the
    sources at their cap are a prefix, found by running sums; one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", given).withColumn("cap", F.col("source_size") * float(repeats))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "source", "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def with_parts(documents, seed, text_col, source_col, id_col):
    """Rows with their size, block, part of the block and place in it. Rows that repeat
    have the same place and are taken alike."""
    key = F.xxhash64(F.lit(seed), id_col, text_col, source_col)
    return (
        documents.withColumn("_source", F.col(source_col).cast("string")).withColumn("_size", word_count(F.col(text_col))).withColumn("_key", key)
        .withColumn("_block", F.pmod("_key", F.lit(BLOCKS))).withColumn("_part", F.pmod(F.shiftrightunsigned("_key", 20), F.lit(BLOCKS)))
    )


def quotas(rows, weights, repeats, seed):
    """Per source: full passes, blocks of the last pass in permuted order with their
    running sizes, the block that is taken in part, and its parts likewise."""
    blocks = rows.groupBy("_source", "_block").agg(F.sum("_size").alias("n"))
    sizes = blocks.groupBy("_source").agg(F.sum("n").alias("source_size")).withColumnRenamed("_source", "source")
    targets = source_targets(sizes, weights, repeats)
    size = F.col("source_size")
    passes = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(repeats))).otherwise(0)
    targets = targets.withColumn("passes", passes.cast("long")).withColumn("wanted", F.when(size > 0, F.col("target") - F.col("passes") * size).otherwise(0.0))
    turn = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    before = F.coalesce(F.sum("n").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.join(targets.withColumnRenamed("source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    blocks = blocks.withColumnRenamed("_source", "source").withColumnRenamed("_block", "block").withColumn("before", before)
    left = F.col("wanted") - F.col("before")
    blocks = blocks.withColumn("state", F.when(left <= 0, "none").when(left >= F.col("n"), "whole").otherwise("cut")).withColumn("left", left)
    return blocks.select("source", "block", "source_size", "target", "passes", "state", "left")


def placed_rows(documents, weights=WEIGHTS, repeats=REPEATS, shards=SHARDS, seed=0, id_col="doc_id", text_col="text", source_col="source"):
    """The rows with _copies (how often the mix wants each), _placed (the copies and
    shards that the splitting tree gave them), _source_size and _target.

    A source's last pass takes whole blocks in permuted order; in the block that would
    exceed the target, whole parts; in the part that would, rows in permuted order
    while at least half of a row is wanted. So a source misses its target by half a
    row, and only a 65,536th of a source is ever ranked together.
    """
    all_rows = with_parts(documents, seed, text_col, source_col, id_col)
    rows = stored(all_rows.select("_source", "_size", "_key", "_block", "_part"), "mix-sizes")
    blocks = quotas(rows, weights, repeats, seed)
    sums = rows.groupBy("_source", "_block", "_part").agg(F.sum("_size").alias("n"))
    cut = blocks.where("state = 'cut'").select("source", "block", "left")
    parts = sums.join(cut, F.col("_source").eqNullSafe(F.col("source")) & (F.col("_block") == F.col("block"))).drop("source", "block")
    turn = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("left") - F.coalesce(F.sum("n").over(turn), F.lit(0))
    parts = parts.select("_source", "_block", "_part", F.when(room <= 0, "none").when(room >= F.col("n"), "whole").otherwise("cut").alias("part_state"), room.alias("room"))
    last = parts.where("part_state = 'cut'").select("_source", "_block", "_part", "room")
    inside = rows.select("_source", "_block", "_part", "_key", "_size")
    same = F.col("_source").eqNullSafe(F.col("s")) & (F.col("_block") == F.col("b")) & (F.col("_part") == F.col("p"))
    inside = inside.join(last.select(F.col("_source").alias("s"), F.col("_block").alias("b"), F.col("_part").alias("p"), "room"), same).drop("s", "b", "p")
    inside = inside.groupBy("_source", "_block", "_part", "_key").agg(F.sum("_size").alias("n"), F.first("room").alias("room"))
    turn = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("n").over(turn), F.lit(0))
    some = inside.where(F.col("n") > 0).withColumn("ahead", ahead).where(F.col("ahead") + F.col("n") / 2 <= F.col("room")).select("_source", "_key")

    # blocks and parts are at most 256 rows per source each
    named = lambda df, **names: df.select(*[F.col(c).alias(n) for c, n in names.items()])
    b = named(blocks, source="_bs", block="_bb", source_size="_source_size", target="_target", passes="_passes", state="_state")
    p = named(parts, _source="_ps", _block="_pb", _part="_pp", part_state="_part_state")
    k = named(some, _source="_ks", _key="_kk").withColumn("_some", F.lit(True))

    def counted(rows, b):
        rows = rows.join(b, F.col("_source").eqNullSafe(F.col("_bs")) & (F.col("_block") == F.col("_bb"))).drop("_bs", "_bb")
        rows = rows.join(p, F.col("_source").eqNullSafe(F.col("_ps")) & (F.col("_block") == F.col("_pb")) & (F.col("_part") == F.col("_pp")), "left").drop("_ps", "_pb", "_pp")
        rows = rows.join(k, F.col("_source").eqNullSafe(F.col("_ks")) & (F.col("_key") == F.col("_kk")), "left").drop("_ks", "_kk")
        once_more = (F.col("_state") == "whole") | F.coalesce(F.col("_part_state") == "whole", F.lit(False)) | F.coalesce(F.col("_some"), F.lit(False))
        return rows.withColumn("_copies", F.col("_passes") + F.when(once_more, 1).otherwise(0)).drop("_passes", "_state", "_part_state", "_some")

    # a block has the copies of its most taken row
    units = counted(rows, b).groupBy("_source", "_block").agg(F.max("_copies").alias("n")).where("n > 0")
    units = units.select("_source", "_block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("_copy"))
    dealt = dealt_units(stored(units, "mix-units"), shards, seed)
    dealt = dealt.groupBy("_source", "_block").agg(F.sort_array(F.collect_list(F.struct("_copy", "_shard"))).alias("_dealt"))
    dealt = named(dealt, _source="_ds", _block="_db", _dealt="_dealt")
    b = b.join(dealt, F.col("_bs").eqNullSafe(F.col("_ds")) & (F.col("_bb") == F.col("_db")), "left").drop("_ds", "_db")
    out = counted(all_rows, b)
    placed = F.filter("_dealt", lambda d: d["_copy"] <= F.col("_copies"))
    return out.withColumn("_placed", F.coalesce(placed, F.array().cast("array<struct<_copy:bigint,_shard:bigint>>"))).drop("_dealt")


def draw_left(seed, level):
    """Fold step: of x's blocks, those that go left, drawn without replacement: each
    with the chance that what is left to draw has among what is left."""

    def one(acc, x):
        chance = lambda i: uniform(F.lit(seed), F.lit(level), F.col("node"), x["source"], i) * (acc["of"] - i)
        step = lambda n, i: n + F.when(chance(i) < acc["draw"] - n, 1).otherwise(0).cast("long")
        units = F.when(x["quota"] > 0, F.sequence(F.lit(0).cast("long"), x["quota"] - 1)).otherwise(F.array().cast("array<long>"))
        drawn = F.array(F.aggregate(units, F.lit(0).cast("long"), step))
        told = lambda n: F.struct(x["source"].alias("source"), x["quota"].alias("quota"), n.alias("left"))
        after = lambda a, n: F.struct((a["draw"] - n).alias("draw"), (a["of"] - x["quota"]).alias("of"), F.concat(a["done"], F.array(told(n))).alias("done"))
        return F.aggregate(drawn, acc, after)

    return one


def shard_quotas(units, shards, seed=0):
    """(source, quota) -> (source, shard, quota) by the splitting tree.

    A node's draw goes source by source: the first source's share is drawn from all,
    the next from what is left, so the totals of both children are exact. The sources
    of a node are one array; their blocks are counts.
    """
    depth = max(shards - 1, 0).bit_length()
    nodes = units.select(F.lit(0).cast("long").alias("node"), "source", "quota")
    for level in range(depth):
        listed = nodes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("source", "quota"))).alias("all"), F.sum("quota").alias("total"))
        start = F.struct(F.floor((F.col("total") + 1) / 2).cast("long").alias("draw"), F.col("total").alias("of"), F.array().cast("array<struct<source:string,quota:bigint,left:bigint>>").alias("done"))
        dealt = listed.select("node", F.explode(F.aggregate("all", start, draw_left(seed, level), lambda a: a["done"])).alias("e"))
        left = dealt.select((F.col("node") * 2).alias("node"), "e.source", F.col("e.left").alias("quota"))
        right = dealt.select((F.col("node") * 2 + 1).alias("node"), "e.source", (F.col("e.quota") - F.col("e.left")).alias("quota"))
        nodes = left.unionByName(right)
    return nodes.withColumnRenamed("node", "shard")


def dealt_units(unit, shards, seed):
    """Blocks' copies (_source, _block, _copy) with their _shard: in permuted order each
    source's units fill the quotas that the splitting tree gave its shards."""
    turn = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed + 2), "_block", "_copy"), "_block", "_copy")
    unit = unit.withColumn("_rank", F.row_number().over(turn))
    dealt = shard_quotas(unit.groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("quota")), shards, seed)
    upto = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumn("hi", F.sum("quota").over(upto)).where("quota > 0").select(F.col("source").alias("_s"), "shard", "hi")
    ranges = dealt.groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("hi", "shard"))).alias("_ranges"))
    shard = F.get(F.filter("_ranges", lambda r: r["hi"] >= F.col("_rank")), F.lit(0))["shard"]
    unit = unit.join(ranges, F.col("_source").eqNullSafe(F.col("_s")))
    return unit.select("_source", "_block", "_copy", shard.alias("_shard")).where("_shard IS NOT NULL")


def copies_of(rows, placed, seed):
    """A row per placed copy, with _copy, _shard and _turn (the shuffled order inside
    the shard)."""
    rows = rows.withColumn("_place", F.explode(placed)).withColumn("_copy", F.col("_place._copy")).withColumn("_shard", F.col("_place._shard"))
    return rows.withColumn("_turn", F.xxhash64(F.lit(seed + 3), "_key", "_copy"))


def mixed(documents, weights=WEIGHTS, repeats=REPEATS, shards=SHARDS, seed=0, id_col="doc_id", text_col="text", source_col="source"):
    """The mix itself: the documents' columns, a row per copy, with _copy, _shard and
    _turn. ``shards`` is rounded up to a power of two. Same input and seed, same mix."""
    rows = placed_rows(documents, weights, repeats, shards, seed, id_col, text_col, source_col)
    return copies_of(rows, F.col("_placed"), seed).select(*documents.columns, "_copy", "_shard", "_turn")


def mix_report(documents, weights=WEIGHTS, repeats=REPEATS, shards=SHARDS, seed=0, id_col="doc_id", text_col="text", source_col="source"):
    """One row per input row: doc_id, size, source_size, target, taken (the words of the
    copies that are in shards).

    Null text has size 0 and is taken without effect; a null source is a source, the
    last; rows that repeat are taken alike; a source of size 0 has target 0; other
    columns are ignored; an empty table gives an empty table.
    """
    rows = placed_rows(documents.select(*dict.fromkeys((id_col, text_col, source_col))), weights, repeats, shards, seed, id_col, text_col, source_col)
    return rows.select(F.col(id_col).alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.size("_placed")).alias("taken"))


def mix_files(documents, path, **options):
    """Write the mix as one shuffled folder per shard."""
    out = mixed(documents, **options)
    out.repartition("_shard").sortWithinPartitions("_shard", "_turn").write.partitionBy("_shard").parquet(path)


def draw(documents, shards=SHARDS, seed=0, id_col="doc_id", text_col="text", source_col="source", **options):
    """The mix with the documents' columns only, whatever their names: a row per copy,
    shard after shard, each in its shuffled order. Rows without words weigh nothing and
    stay once, in a shard by their hash."""
    rows, name, back = masked(documents)
    rows = placed_rows(rows, shards=shards, seed=seed, id_col=name[id_col], text_col=name[text_col], source_col=name[source_col], **options)
    anywhere = F.pmod(F.shiftrightunsigned("_key", 40), F.lit(1 << max(shards - 1, 0).bit_length()))
    alone = F.array(F.struct(F.lit(1).cast("long").alias("_copy"), anywhere.alias("_shard")))
    copies = copies_of(rows, F.when(F.col("_size") == 0, alone).otherwise(F.col("_placed")), seed)
    return back(copies.orderBy("_shard", "_turn"))
