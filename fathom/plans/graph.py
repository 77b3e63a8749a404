"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node, root from links(a, b), a written table: each component's nodes get one root.

    Each turn points every node at its least neighbour, if that is less than
    itself, and contracts the links along these pointers. Turns order nodes by
    id, which takes a star in one turn, and by random rank, which shortens any
    chain, alternately. All that is kept is written tables.
    """
    found, turn = None, 0
    while found is None or not links.isEmpty():
        rank = (lambda c: F.xxhash64(F.lit(turn), c)) if turn % 2 else (lambda c: c)  # noqa: B023
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.min(F.struct(rank(F.col("v")).alias("r"), "v")).alias("m"))
        up = scratch.save(least.select("u", F.when(F.col("m.r") < rank(F.col("u")), F.col("m.v")).otherwise(F.col("u")).alias("up")), f"{label}up{turn}")
        if found is None:
            found = up.toDF("node", "root")
        else:
            moved = found.join(up, F.col("root") == F.col("u"), "left").select("node", F.coalesce("up", "root").alias("root"))
            found = scratch.save(moved, f"{label}root{turn}")
        over = links.join(up.toDF("a", "p"), "a").join(up.toDF("b", "q"), "b").where("p <> q")
        links = scratch.save(over.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), f"{label}over{turn}")
        turn += 1
    return found
