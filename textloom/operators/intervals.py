"""Intervals and lattices as tables: containment, overlap, edges that meet, and what lies on a way from beginning to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import checkpointed


def contained(inner: DataFrame, outer: DataFrame, id_col: str) -> DataFrame:
    """inner's rows (id, begin, end, ...) with outer_begin and outer_end of each interval of the same id that holds them: an equi-join on the id, the places are compared behind it."""
    o = outer.select(F.col(id_col), F.col("begin").alias("outer_begin"), F.col("end").alias("outer_end"))
    return inner.join(o, id_col).where((F.col("outer_begin") <= F.col("begin")) & (F.col("end") <= F.col("outer_end")))


def overlapping(spans: DataFrame, id_col: str) -> DataFrame:
    """Rows whose interval begins before an earlier one of the same id has ended (in the order of begin and end). Empty intervals overlap nothing."""
    order = Window.partitionBy(id_col).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    return spans.where(F.col("end") > F.col("begin")).withColumn("reach", F.max("end").over(order)).where(F.col("begin") < F.col("reach")).drop("reach")


def edges(nodes: DataFrame, id_col: str, node_col: str) -> DataFrame:
    """id, before, after: nodes of one id of which one ends where the other begins."""
    a = nodes.select(F.col(id_col), F.col(node_col).alias("before"), F.col("end").alias("place"))
    b = nodes.select(F.col(id_col), F.col(node_col).alias("after"), F.col("begin").alias("place"))
    return a.join(b, [id_col, "place"]).select(F.col(id_col).alias("id"), "before", "after")


def useful(nodes: DataFrame, sizes: DataFrame, id_col: str) -> DataFrame:
    """Nodes that lie on a way from 0 to the size of their id (sizes: id, size). Places that can be reached spread from either end, a round for each step of the longest way, until nothing is new."""
    def reach(first: DataFrame, come: str, go: str) -> DataFrame:
        known = checkpointed(first.distinct())
        new = known
        while new.limit(1).count():
            step = nodes.join(new, [F.col(come) == F.col("place"), nodes[id_col] == new["id_"]]).select(F.col("id_"), F.col(go).alias("place")).distinct()
            new = checkpointed(step.join(known, ["id_", "place"], "left_anti"))
            known = checkpointed(known.unionByName(new))
        return known

    ids = sizes.select(F.col(id_col).alias("id_"), "size")
    ahead = reach(ids.select("id_", F.lit(0).alias("place")), "begin", "end")
    back = reach(ids.select("id_", F.col("size").alias("place")), "end", "begin")
    a, b = ahead.select(F.col("id_").alias(id_col), F.col("place").alias("begin")), back.select(F.col("id_").alias(id_col), F.col("place").alias("end"))
    return nodes.join(a, [id_col, "begin"], "left_semi").join(b, [id_col, "end"], "left_semi").select(*nodes.columns)
