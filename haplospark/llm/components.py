"""Connected components of a graph of links, as joins and minima: no part of it reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.llm import _common


def components(links: DataFrame) -> DataFrame:
    """id, label (the smallest id that links reach) of each id in links(a, b).

    Each round takes the least label among neighbours and then the label of one's label, which
    doubles the reach; rounds are written to the shared folder.  It ends when no link has two labels.  An id with
    very many links, and a label of very many ids, are split from the joins' other keys.
    """
    links = _common.stored(links.where("a != b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), "links")
    both = links.unionAll(links.selectExpr("b", "a"))
    busy = _common.hot_keys(both, "b")
    labels = _common.stored(both.groupBy("a").agg(F.min("b").alias("low")).selectExpr("a as id", "least(a, low) as label"), "labels")
    while True:
        near = _common.joined(both, labels.withColumnRenamed("id", "b"), "b", busy).groupBy("a").agg(F.min("label").alias("low"))
        lower = _common.stored(labels.join(near, F.col("id") == F.col("a")).selectExpr("id", "least(label, low) as label"), "lower")
        jump = labels.selectExpr("id as label", "label as further")
        labels = _common.stored(_common.joined(lower, jump, "label", _common.hot_keys(lower, "label"), "left").selectExpr("id", "least(label, further) as label"), "labels")
        ends = _common.joined(links, labels.selectExpr("id as a", "label as x"), "a", busy)
        if _common.joined(ends, labels.selectExpr("id as b", "label as y"), "b", busy).where("x != y").isEmpty():
            return labels
