"""Connected components of a link table, without ever holding the graph in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import written

#: More rounds than any graph needs: the number of rounds grows with the logarithm of its nodes.
MAX_ROUNDS = 200


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every
    node's larger neighbours are tied to its smallest one, then its smaller
    neighbours are. Each round is two grouped minima and two joins; links shrink to
    one per node. Rounds are written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    links = written(
        links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links"
    )
    mark = _mark(links)
    for _ in range(MAX_ROUNDS):
        both = links.union(links.select(b.alias("a"), a.alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(lowest, "a").filter(b > a).select(b.alias("a"), F.col("low").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").filter(b != F.col("low")).select(b.alias("a"), F.col("low").alias("b"))
        links = written(small.union(lowest.select("a", F.col("low").alias("b"))).distinct(), "links")
        last, mark = mark, _mark(links)
        if mark == last:
            return links.select(a.alias("node"), b.alias("root")).union(
                links.select(b.alias("node"), b.alias("root")).distinct()
            )
    raise RuntimeError("components did not settle")
