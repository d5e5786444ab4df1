"""The descendant axis of a node table, by a stack over sorted intervals."""

import pyarrow as pa
from pyspark.sql import functions as F

PAIRS = 1 << 16  # pairs handed on at once


def _pairs(keys, ancestors, tags, kinds):
    """Arrow pass: rows in order of key and node_id -> (ancestor, descendant) rows.

    The open ancestors of the place that is read form a stack, because intervals of one
    page nest; each is left for good once its end is passed. The stack and the page go on
    from batch to batch, so a page may be longer than a batch and nothing of it is kept
    but the elements around the current one.
    """
    names = [*keys, "ancestor_id", "ancestor_tag", "node_id", "tag"]

    def run(batches):
        page, last, stack, out = None, -1, [], []

        def rows():
            kept, pairs = [o[0] for o in out], [o[1:] for o in out]
            columns = [pa.array([k[i] for k in kept], kinds[i]) for i in range(len(keys))]
            types = [pa.int32(), pa.string(), pa.int32(), pa.string()]
            columns += [pa.array([p[i] for p in pairs], t) for i, t in enumerate(types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys) + 3)]
            for *key, node, end, tag in zip(*columns):
                if key != page or node <= last:
                    page, stack = key, []
                last = node
                while stack and stack[-1][1] < node:
                    stack.pop()
                if tag in tags:
                    out.extend((page, a, name, node, tag) for a, _, name in stack)
                if tag in ancestors:
                    stack.append((node, end, tag))
                if len(out) >= PAIRS:
                    yield rows()
        if out:
            yield rows()

    return run


def descendants(nodes, ancestors, tags, keys=("page_id",), presorted=False):
    """(keys..., ancestor_id, ancestor_tag, node_id, tag) for every element with one of
    ``tags`` below an element with one of ``ancestors``: a structural join, linear in its
    input and its output, with no range condition.

    ``presorted`` takes the rows as ``html_nodes`` without ``tags`` gives them, each page's
    elements together and in order, and needs no shuffle; a page ends where the key changes
    or the numbers begin again, so repeated pages stay apart. Otherwise the rows are dealt
    by key and sorted, and a key stands for one page. A null key is a key; a node without
    number or end is in no pair.
    """
    keys = list(keys)
    narrow = nodes.select(*keys, "node_id", "end_id", "tag").where("node_id IS NOT NULL AND end_id IS NOT NULL")
    if not presorted:
        wanted = narrow.where(F.col("tag").isin([*ancestors, *tags]))
        narrow = wanted.repartition(*keys).sortWithinPartitions(*keys, "node_id")
    kept = [f for f in narrow.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    kinds = [_arrow(f.dataType) for f in kept]
    pairs = _pairs(keys, frozenset(ancestors), frozenset(tags), kinds)
    return narrow.mapInArrow(pairs, f"{schema}, ancestor_id int, ancestor_tag string, node_id int, tag string")


def _arrow(kind):
    """The Arrow type of a key; keys are whole numbers or strings."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
