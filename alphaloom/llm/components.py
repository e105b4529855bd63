"""Connected components of a distributed edge table, by alternating large and small stars.

Nothing is gathered on the driver but two numbers a round. A node with very many edges is only aggregated over (min) and
joined, which Spark can combine before the shuffle and split after it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _forest(batches):
    """Within each batch, edges as a star per component: fewer rows with the same components."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy() for k in (0, 1))
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = np.arange(len(nodes))
        a, b = flat[: len(a)], flat[len(a) :]
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all() and (label[a] == label[b]).all():
                break
            label = new
        far = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.record_batch([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge in `edges` (a, b longs): root is the smallest node reachable.

    Edges with a null end and loops say nothing and are left out.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = saved(edges.mapInArrow(_forest, "a long, b long").distinct(), "edges")
    state = None
    while True:
        seen = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if seen == state or not seen[0]:
            break
        state = seen
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
