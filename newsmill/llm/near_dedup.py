"""Near-duplicate documents by a chosen-path similarity join of shingle sets.

Each set is seen through its minwise tokens (for each of ``TOKENS`` hash functions
the token with the smallest value). Every tree sends a document down the paths of
selected minwise tokens: a node looks at ``BRANCHES`` of the functions, and a
document goes to one child for each, named by its token there; two sets meet in a
child with a chance equal to their similarity. A node with one document is dropped,
one of at most ``SMALL`` is compared in full, a larger one branches on, down to ``DEPTH``
or until it keeps ``DENSE`` of its parent's documents, or one of its children would keep
as much of it: these then are near copies.
Branching goes on where documents share but a passage: they part at every level, while
a pair at 0.75 stays together on 1.5 paths of 2 at each, so depth costs no recall. Trees are independent; ``TREES`` of them miss a pair at 0.75 with a chance
of (1 - 0.75)^(2 * 10), about 1e-12, where nodes get small at once, and of about 1e-8
where they do not.

* Documents with equal sets are one class before the join.
* Links are needed for components only: each document first confirms its likeliest
  link. Then the documents with a likely pair between different components bring their
  full sets to the first node where that pair meets, and the node compares them there.
  Pairs are never rows: a document is at most one row of each of its nodes, so a group
  costs the same for each document whatever its size.
* A node that is large and branches no more is cut into blocks; those outside the
  node's largest component then meet every block, so no link is lost there either.
* Every link is confirmed on the full sets (48-bit shingle hashes).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from newsmill.llm import arrays as A
from newsmill.llm.graph import components

TOKENS, PATH_TOKENS, TREES, BRANCHES, DEPTH, SMALL, BLOCK = 256, 64, 10, 2, 6, 256, 256
# documents of a block of the second pass; a row there is a document, never a pair
CROWD = 4096
# a node with this share of its parent's documents holds near copies; more levels would not part them
DENSE = 0.8
# a full set counts as this many rows where tasks are sized
SET_ROWS = 8
# one document of this many of a large node shows whether its children would be dense
SHOWN = 16
# a sketch has 4 bits of each token; of 256 a pair at 0.75 shares 196 +- 7, fewer than
# this with a chance of 4e-9 if tokens are independent, a pair at 0.8 with one of 4e-15
LIKELY = 155
FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**62, TOKENS, dtype=np.uint64) * A.U(2) + A.U(1)


def choices(seed=11):
    """Token of each child of each tree; children of a node take different tokens and
    no token returns on a path, as each level has tokens of its own."""
    rnd, share = np.random.Generator(np.random.PCG64(seed)), PATH_TOKENS // DEPTH
    out = np.zeros((TREES, sum(BRANCHES**level for level in range(DEPTH + 1))), np.int64)
    for tree in range(TREES):
        order, child = rnd.permutation(PATH_TOKENS), 1
        for level in range(DEPTH):
            for _ in range(BRANCHES**level):
                out[tree, child : child + BRANCHES] = order[level * share + rnd.permutation(share)[:BRANCHES]]
                child += BRANCHES
    return out


CHOICE = choices()
CHILDREN = "node long, path long, key long, parent long"
SETS = "key long, n_shingles long, s1 long, s2 long, mins binary, sketch binary"


def shingle_sets(offs, raw, words):
    """(hashes, row) of the distinct shingles of each row, sorted by both."""
    raw = A.LOWER[raw]
    starts, ends, row = A.words_of(offs, raw)
    h = A.word_hashes(raw, starts, ends)
    grams = A.ordered_hashes(h, words)
    r = row[: len(grams)]
    whole = r == row[words - 1 :] if len(grams) else np.zeros(0, bool)
    grams, r = grams[whole], r[whole]
    counts = np.bincount(row, minlength=len(offs) - 1)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.searchsorted(row, short)
        odd = np.array([int(A.mix(np.bitwise_xor.reduce(A.mix(h[f : f + c] + np.arange(c, dtype=np.uint64) * A.STEP), keepdims=True) + A.U(c))[0]) for f, c in zip(first, counts[short])], np.uint64)
        grams, r = np.concatenate((grams, odd)), np.concatenate((r, short))
    order = np.lexsort((grams, r))
    grams, r = grams[order], r[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], r[new]


def nibbles(mins):
    """Four bits of each token, two tokens a byte."""
    v = ((mins ^ (mins >> 13)) & 15).astype(np.uint8)
    return v[:, ::2] | (v[:, 1::2] << 4)


def describe_sets(words):
    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for i, offs, raw in A.text_blocks(batch.column("text")):
                n_rows = len(offs) - 1
                grams, row = shingle_sets(offs, raw, words)
                sizes = np.bincount(row, minlength=n_rows)
                full = np.flatnonzero(sizes)
                at = np.cumsum(sizes[full]) - sizes[full]
                s1, s2 = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
                mins = np.zeros((n_rows, TOKENS), np.uint32)
                if len(full):
                    s1[full] = np.add.reduceat(A.mix(grams), at)
                    s2[full] = np.bitwise_xor.reduceat(A.mix(grams + A.STEP), at)
                    for t in range(TOKENS):
                        v = grams * FACTORS[t]
                        mins[full, t] = (np.minimum.reduceat(v ^ (v >> A.U(32)), at) >> A.U(16)).astype(np.uint32)
                flat = lambda m: pa.Array.from_buffers(pa.binary(m.shape[1] * m.itemsize), n_rows, [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())
                columns = [pa.array(keys[i : i + n_rows]), pa.array(sizes.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), flat(mins[:, :PATH_TOKENS]), flat(nibbles(mins))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_shingles", "s1", "s2", "mins", "sketch"])

    return run


def matrix(column, kind, width):
    """Rows of equal size as one array."""
    for _, _, data in A.text_blocks(column, 1 << 40):
        return np.ascontiguousarray(data).view(kind).reshape(-1, width)
    return np.zeros((0, width), kind)


def descend(level):
    """Children of each (node, path) for the tokens of its document."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            mins = matrix(batch.column("mins"), np.uint32, PATH_TOKENS)
            keys = batch.column("key").to_numpy()
            if level:
                starts = [(batch.column("node").to_numpy().view(np.uint64), batch.column("path").to_numpy(), batch.column("n"))]
            else:
                none = pa.nulls(len(keys), pa.int64())
                starts = [(np.full(len(keys), t + 1, np.uint64), np.full(len(keys), t * CHOICE.shape[1], np.int64), none) for t in range(TREES)]
            for node, path, parent in starts:
                tree, place = path // CHOICE.shape[1], path % CHOICE.shape[1]
                for b in range(BRANCHES):
                    child = place * BRANCHES + b + 1
                    token = mins[np.arange(len(keys)), CHOICE[tree, child]]
                    name = A.mix(A.mix(node * A.STEP + child.astype(np.uint64)) + token.astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(tree * CHOICE.shape[1] + child), pa.array(keys), parent], names=["node", "path", "key", "parent"])

    return run


def whole_groups(batches, column):
    """Batches that end where a group ends; input is sorted by the column."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        g = batch.column(column).to_numpy()
        others = np.flatnonzero(g != g[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut or (held and held[-1].column(column)[-1].as_py() != int(g[-1])):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def likely_pairs(group, key, size, sketch, share, usable, limit=1 << 17):
    """(i, j, agreement) of rows of one group that may be linked; blocks of pairs. Sets
    whose sizes differ more than the similarity allows are never linked."""
    for d in range(1, len(group)):
        i = np.flatnonzero(group[:-d] == group[d:])
        if not len(i):
            return
        low, high = np.minimum(size[i], size[i + d]), np.maximum(size[i], size[i + d])
        i = i[usable(i, i + d) & (key[i] != key[i + d]) & (low >= share * high)]
        for s in range(0, len(i), limit):
            a = i[s : s + limit]
            apart = sketch[a] ^ sketch[a + d]
            same = ((apart & 15) == 0).sum(1) + (apart < 16).sum(1)
            hit = same >= LIKELY
            yield a[hit], a[hit] + d, same[hit]


def likeliest(similarity):
    """For each document of a node the likeliest link to one with a smaller key."""

    def run(batches):
        for table in whole_groups(batches, "node"):
            group, key, size = (table.column(c).to_numpy() for c in ("node", "key", "n_shingles"))
            sketch = matrix(table.column("sketch"), np.uint8, TOKENS // 2)
            best, other = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            for i, j, same in likely_pairs(group, key, size, sketch, similarity, lambda i, j: np.ones(len(i), bool)):
                hi, lo = np.where(key[i] > key[j], i, j), np.where(key[i] > key[j], j, i)
                # a row is the larger side of at most two pairs at one distance
                for part in (hi == i, hi == j):
                    w = part & ((same > best[hi]) | ((same == best[hi]) & (key[lo] < other[hi])))
                    best[hi[w]], other[hi[w]] = same[w], key[lo[w]]
            x = best > 0
            yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(other[x]), pa.array(best[x])], names=["x", "y", "same"])

    return run


def met_before(table):
    """Whether two rows also share a node that comes before the one they are in."""
    path, met = table.column("path").to_numpy(), table.column("met").combine_chunks()
    slots, names = np.asarray(met.flatten().field("path")), np.asarray(met.flatten().field("name"))
    used, column = np.unique(slots, return_inverse=True)
    seen = np.zeros((len(path), len(used)), np.int32)
    seen[np.repeat(np.arange(len(path)), np.diff(np.asarray(met.offsets))), column] = names

    def test(i, j, limit=1 << 17):
        out = np.zeros(len(i), bool)
        for s in range(0, len(i), limit):
            a, b = i[s : s + limit], j[s : s + limit]
            out[s : s + limit] = ((seen[a] == seen[b]) & (seen[a] != 0) & (used < path[a][:, None])).any(1)
        return out

    return test


def undecided(similarity):
    """Rows of documents that have a likely pair between different components in this
    node and in none before it; where a group has guests, only pairs with a guest."""

    def run(batches):
        for table in whole_groups(batches, "node"):
            group, key, size, root = (table.column(c).to_numpy() for c in ("node", "key", "n_shingles", "root"))
            guest = table.column("guest").to_numpy().astype(np.int8)
            sketch, before = matrix(table.column("sketch"), np.uint8, TOKENS // 2), met_before(table)
            # 0: an ordinary node; 1: a member of a visited block; 3: its guest
            usable = lambda i, j: (root[i] != root[j]) & (guest[i] + guest[j] != 2)
            open_ = np.zeros(len(key), bool)
            for i, j, _ in likely_pairs(group, key, size, sketch, similarity, usable):
                new = ~before(i, j)
                open_[i[new]] = open_[j[new]] = True
            yield from table.select(["node", "key", "root", "guest"]).filter(pa.array(open_)).to_batches()

    return run


def links_of_node(tokens, root, guest, similarity):
    """Links of one group between different components, as (i, j): enough of them to
    join the components that links join. Counts are exact."""
    sets = [unpacked(t) for t in tokens]
    size = np.array([len(x) for x in sets])
    at = np.cumsum(size) - size
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own, root, percent = np.zeros(len(names), np.int64), root.copy(), round(100 * similarity)
    for i in range(len(sets) - 1):
        small, large = np.minimum(size, size[i]), np.maximum(size, size[i])
        likely = (root != root[i]) & (guest + guest[i] != 2) & (100 * small >= percent * large)
        likely[: i + 1] = False
        j = np.flatnonzero(likely)
        if not len(j):
            continue
        mine = ids[at[i] : at[i] + size[i]]
        own[mine] = 1
        if 4 * len(j) > len(sets) - i:
            both = np.add.reduceat(own[ids], at)[j]
        else:
            both = np.array([own[ids[at[k] : at[k] + size[k]]].sum() for k in j])
        own[mine] = 0
        for k in j[100 * both >= percent * (size[i] + size[j] - both)]:
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                yield i, k


def decide(similarity):
    """Confirmed links between the components of each group, on the full sets, as links of
    the components' roots."""

    def run(batches):
        for table in whole_groups(batches, "node"):
            group, named = (table.column(c).to_numpy() for c in ("node", "root"))
            guest, tokens = table.column("guest").to_numpy().astype(np.int8), table.column("tokens")
            cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
            for a, b in zip(cuts[:-1], cuts[1:]):
                found = list(links_of_node(tokens.slice(a, b - a).to_pylist(), named[a:b], guest[a:b], similarity))
                i, j = np.array(found, np.int64).reshape(-1, 2).T + a
                x, y = named[i], named[j]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["x", "y"])

    return run


def full_sets(words):
    """48-bit shingle hashes of each text, sorted."""

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for i, offs, raw in A.text_blocks(batch.column("text")):
                grams, row = shingle_sets(offs, raw, words)
                cuts = np.searchsorted(row, np.arange(len(offs)))
                sets = [np.sort(grams[a:b] >> A.U(16)) for a, b in zip(cuts[:-1], cuts[1:])]
                packed = [s.astype("<u4").tobytes() + (s >> A.U(32)).astype("<u2").tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + len(packed)]), pa.array(packed, pa.binary())], names=["key", "tokens"])

    return run


def unpacked(tokens):
    n = len(tokens) // 6
    return np.frombuffer(tokens, "<u4", n).astype(np.uint64) | (np.frombuffer(tokens, "<u2", n, 4 * n).astype(np.uint64) << A.U(32))


def confirm(similarity):
    def run(batches):
        for batch in batches:
            x, y, left, right = (batch.column(c).to_pylist() for c in ("x", "y", "left", "right"))
            keep = []
            for a, b in zip(left, right):
                small, large = sorted((len(a), len(b)))
                if 100 * small < 100 * similarity * large:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(unpacked(a), unpacked(b), assume_unique=True))
                keep.append(100 * both >= round(100 * similarity) * ((small + large) // 6 - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()).filter(keep), pa.array(y, pa.int64()).filter(keep)], names=["x", "y"])

    return run


def confirmed(pairs, sets, similarity):
    left = sets.select(F.col("key").alias("x"), F.col("tokens").alias("left"))
    right = sets.select(F.col("key").alias("y"), F.col("tokens").alias("right"))
    return pairs.select("x", "y").join(left, "x").join(right, "y").mapInArrow(confirm(similarity), "x long, y long")


def dense_below(rows, reps, level):
    """(node, dense) of nodes whose largest child would keep DENSE of them, judged by a
    part of their documents. Such a node branches no more and is compared in blocks, so
    the estimate decides how its pairs are found, never which are links."""
    part = rows.where(F.pmod(F.xxhash64("key", "node"), F.lit(SHOWN)) == 0).select("node", "path", "key")
    part = part.join(reps.select("key", "mins"), "key")
    # the part's node goes along in the place of the parent's size
    below = part.select("node", "path", "key", "mins", F.col("node").alias("n")).mapInArrow(descend(level), CHILDREN)
    below = below.groupBy("parent", "node").agg(F.count(F.lit(1)).alias("c"))
    # each document of the part is in one child for each branch
    dense = F.max("c") * BRANCHES >= DENSE * F.sum("c")
    return below.groupBy("parent").agg(dense.alias("dense")).withColumnRenamed("parent", "node")


def nodes_to_compare(reps):
    return found_nodes(reps)[0]


def found_nodes(reps):
    """(node, path, key, blocks), and the stored tables it reads: nodes with two documents or more; ``blocks`` above 1
    says that the node is large and branches no more. Each step is stored once, and what
    is read no more is deleted."""
    found, used, rows = [], [], reps.select("key", "mins").mapInArrow(descend(0), CHILDREN)
    n_rows = TREES * BRANCHES * reps.count()
    for level in range(1, DEPTH + 1):
        paths = A.stored(rows, "paths", n_rows)
        sizes = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = A.stored(paths.join(sizes, "node"), "paths", n_rows)
        A.dropped(paths)
        used.append(rows)
        large = F.col("n") > SMALL
        stop = F.lit(True) if level == DEPTH else F.coalesce(F.col("n") >= DENSE * F.col("parent"), F.lit(False))
        n_rows = BRANCHES * rows.where(large & ~stop).count()
        if n_rows:
            dense = A.stored(dense_below(rows.where(large & ~stop), reps, level).where("dense"), "dense-nodes", n_rows // SMALL)
            used.append(dense)
            rows = rows.join(dense, "node", "left")
            stop = stop | F.coalesce("dense", F.lit(False))
        blocks = F.when(large, F.ceil(F.col("n") / BLOCK)).otherwise(1).cast("long").alias("blocks")
        found.append(rows.where(~large | stop).select("node", "path", "key", blocks))
        rows = rows.where(large & ~stop)
        if not n_rows or rows.isEmpty():
            break
        rows = rows.join(reps.select("key", "mins"), "key").select("node", "path", "key", "mins", "n").mapInArrow(descend(level), CHILDREN)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, used


def visits(nodes):
    """Groups for the second pass: nodes as they are, and for each large node its
    blocks, visited by those outside the node's largest component."""
    carried = ["path", "met", "key", "n_shingles", "root", "sketch"]
    plain = nodes.where("blocks = 1").select("node", *carried, F.lit(0).alias("guest"))
    large = nodes.where("blocks > 1")
    main = large.groupBy("node", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
    strays = large.join(main, "node").where("root <> main").drop("main")
    crowd = strays.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / CROWD).alias("crowds"))
    many = F.ceil(F.col("blocks") * BLOCK / CROWD)
    block = F.pmod(F.xxhash64("key", "node"), many)
    group = lambda b, c: F.xxhash64("node", b, c).alias("node")
    hosts = large.join(crowd, "node").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("crowds") - 1)))
    hosts = hosts.select(group(block, F.col("c")), *carried, F.lit(1).alias("guest"))
    guests = strays.join(crowd, "node").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
    guests = guests.select(group(F.col("b"), F.pmod(F.xxhash64("node", "key"), F.col("crowds"))), *carried, F.lit(3).alias("guest"))
    return plain.unionByName(hosts).unionByName(guests)


def near_components(documents, words=5, similarity=0.75, id_col="doc_id", text_col="text"):
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A set holds the distinct shingles of ``words`` lower-cased words; a shorter text is
    one shingle; a text without words has an empty set and is linked with nothing.
    Null text is empty. ``component_id`` is the smallest id of the component (null only
    if no id is known), ``kept`` is true where it is the row's own id; rows that repeat
    share it. Other columns are ignored; an empty table gives an empty table.
    """
    A.ready(documents.sparkSession)
    docs = A.keyed_texts(documents, id_col, text_col)
    sets = A.stored(docs.select("key", "text").mapInArrow(describe_sets(words), SETS).join(docs.select("key", "doc_id").distinct(), "key"), "shingle-sets")
    same = ["n_shingles", "s1", "s2"]
    reps = sets.where("n_shingles > 0").groupBy(*same).agg(F.min_by(F.struct("key", "mins", "sketch"), "key").alias("r"), F.min("doc_id").alias("low"))
    n_sets = sets.count()
    reps = A.stored(reps.select(*same, "low", "r.*"), "set-classes", n_sets)
    # what the result needs stays, without tokens; all else goes when it is no longer read
    described = A.stored(sets.select("key", "doc_id", *same), "set-names", n_sets)
    A.dropped(sets)
    n_reps = reps.count()

    # one row for each document: at most one node for each path
    nodes, used = found_nodes(reps)
    nodes = nodes.groupBy("key").agg(F.collect_list(F.struct("path", "node", "blocks")).alias("nodes"))
    met = F.transform("nodes", lambda n: F.struct(n["path"].alias("path"), n["node"].bitwiseAND(0x7FFFFFFF).cast("int").alias("name")))
    nodes = nodes.withColumn("met", met).join(reps.select("key", "n_shingles", "sketch"), "key")
    nodes = A.stored(nodes.select("key", "n_shingles", "sketch", "met", F.inline("nodes")), "path-nodes", TREES * BRANCHES * n_reps)
    A.dropped(*used)
    classes = A.stored(reps.select(*same, "low", "key"), "class-names", n_reps)
    A.dropped(reps)
    block = F.when(F.col("blocks") > 1, F.xxhash64("node", F.pmod(F.xxhash64("key", "node"), F.col("blocks")))).otherwise(F.col("node"))
    first = nodes.select(block.alias("node"), "key", "n_shingles", "sketch").repartition("node").sortWithinPartitions("node")
    first = A.stored(first.mapInArrow(likeliest(similarity), "x long, y long, same long").groupBy("x").agg(F.max_by("y", F.struct("same", "y")).alias("y")), "likeliest", n_reps)
    involved = nodes.select("key").distinct()
    linked = A.stored(docs.select("key", "text").join(involved, "key", "left_semi").dropDuplicates(["key"]).mapInArrow(full_sets(words), "key long, tokens binary"), "full-sets", SET_ROWS * n_reps)
    links = A.stored(confirmed(first, linked, similarity), "confirmed", SET_ROWS * n_reps)
    roots = components(links)

    named = nodes.join(roots.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    again = visits(named).repartition("node").sortWithinPartitions("node").mapInArrow(undecided(similarity), "node long, key long, root long, guest int")
    again = again.join(linked, "key").repartition("node").sortWithinPartitions("node")
    more = A.stored(again.mapInArrow(decide(similarity), "x long, y long"), "confirmed")
    A.dropped(nodes, first, linked, links)
    if not more.isEmpty():  # links of components, each named by its root
        higher = components(more).select(F.col("v").alias("root"), F.col("root").alias("top"))
        below = roots.join(higher, "root", "left").select("v", F.coalesce("top", "root").alias("root"))
        roots = below.unionByName(higher.select(F.col("root").alias("v"), F.col("top").alias("root")))

    classes = classes.join(roots.withColumnRenamed("v", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(lowest, "root").select(*same, "component_id")
    out = described.select("key", "doc_id", *same).join(classes, same, "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("key", "doc_id", "n_shingles", own.alias("component_id"), (own.eqNullSafe(F.col("doc_id"))).alias("kept"))


def near_dedup(documents, words=5, similarity=0.75, id_col="doc_id", text_col="text"):
    """``near_components`` with one row per input row."""
    found = near_components(documents, words, similarity, id_col, text_col).drop("doc_id")
    docs = A.keyed_texts(documents, id_col, text_col).select("doc_id", "key")
    return docs.join(found.dropDuplicates(["key"]), "key").select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(documents, words=5, similarity=0.75, id_col="doc_id", text_col="text"):
    """The documents, all columns, with one row of each component: the one with the
    smallest id; of rows that share it, the first by key. Rows without words all stay.
    Columns of any name are kept as they are."""
    rows, name, back = A.masked(documents)
    id_col, text_col = name[id_col], name[text_col]
    found = near_components(rows, words, similarity, id_col, text_col)
    kept = found.where("kept").select(F.col("key").alias("_key"), "component_id", "n_shingles")
    first = kept.where("n_shingles > 0").groupBy("component_id").agg(F.min("_key").alias("_key"))
    stay = first.select("_key", F.lit(True).alias("_one")).unionByName(kept.where("n_shingles = 0").select("_key", F.lit(False).alias("_one")).distinct())
    key = F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit("")))
    rows = rows.withColumn("_key", key).join(stay, "_key")
    many = rows.where("_one").dropDuplicates(["_key"])
    return back(many.unionByName(rows.where("NOT _one")))
