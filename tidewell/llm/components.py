"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import drop_stored, stored

#: Links whose trees a task holds at a time.
HELD_LINKS = 500_000
#: Up to so many stars one task finishes; their nodes are at most twice as many, so that it holds them all.
FEW_STARS = 200_000


def _stars(batches, roots: bool = False):
    """For each of the task's nodes a link (a, b) to the smallest node that the task's own links reach; with `roots`
    also for those that are the smallest themselves."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def flush():
        told = [(x, r) for x in parent if (r := root(x)) != x or roots]
        return pa.RecordBatch.from_arrays([pa.array([t[i] for t in told], kind) for i in (0, 1)], ["a", "b"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > HELD_LINKS:
            yield flush()
            parent.clear()
    if parent:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b) that links to another: label is the smallest node
    that it can reach. Tasks first replace their own links by stars, so that a group that brings many
    links goes on with one for each node and task. A few stars are finished by one task. Of more, each round then takes the smallest label among a
    node's neighbours and the label of that label, so that long chains halve. Each round's labels are
    written, which cuts the lineage."""
    kind = links.schema["a"].dataType.simpleString()
    stars = stored(links.select("a", "b").mapInArrow(_stars, f"a {kind}, b {kind}"))
    if stars.count() <= FEW_STARS:
        labels = stored(stars.coalesce(1).mapInArrow(lambda batches: _stars(batches, roots=True), f"a {kind}, b {kind}").toDF("node", "label"), "labels")
        drop_stored(stars)
        return labels
    both = stored(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    drop_stored(stars)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        # Hooking the old label as well lets whole trees join at once.
        lower = stored(labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("new")))
        hooks = stored(lower.filter("new < label").groupBy("label").agg(F.min("new").alias("hook")).withColumnRenamed("label", "old"))
        if not hooks.take(1):
            for old in (both, lower, hooks):
                drop_stored(old)
            return labels
        step = stored(lower.join(hooks, lower.new == hooks.old, "left").select("node", F.least("new", F.coalesce("hook", "new")).alias("label")))
        jump = step.select(F.col("node").alias("at"), F.col("label").alias("to"))
        following = stored(step.join(jump, step.label == jump["at"]).select("node", F.least("label", "to").alias("label")), "labels")
        for old in (labels, lower, hooks, step):
            drop_stored(old)
        labels = following


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components of labels (as components() gives them) with further links."""
    if not links.take(1):
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).filter("a != b").unionByName(links.select("a", "b")))
