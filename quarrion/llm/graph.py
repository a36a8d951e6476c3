"""Connected components over edge tables, and joins that spread hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A key with a share of 1 / HOT of the rows is hot; there are HOT such keys at most, which bounds what is broadcast.
HOT = 1000
#: Marks for each wanted key, and at most: the map of marks has 16 MB at any size.
MARKS, MOST_MARKS, MAP_BITS = 64, 1 << 27, 1 << 15


def sift(rows: DataFrame, wanted: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose keys are in wanted, and some others: for joins that would shuffle rows of which few are wanted.  With
    how="left_anti" all rows but these, null keys among them.

    Every wanted key is a bit, by its hash, of a map that is broadcast.  The map is bounded, so of very many keys it lets more
    others pass, and none that is wanted is lost.
    """
    bits = min(MOST_MARKS, max(MAP_BITS, 1 << (MARKS * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(*keys), F.lit(bits))
    marks = wanted.select((place / MAP_BITS).cast("int").alias("sift_map"), (place % MAP_BITS).alias("bit"))
    # dealt by map first, so no task holds maps that another one holds too
    maps = marks.repartition("sift_map").groupBy("sift_map").agg(F.bitmap_construct_agg("bit").alias("sift_bits"))
    at = place % MAP_BITS
    byte = F.conv(F.hex(F.substring(F.col("sift_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(maps), ((place / MAP_BITS).cast("int") == F.col("sift_map")) & (F.getbit(byte, (at % 8).cast("int")) == 1), how)


def join_spread(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, hint: str | None = None) -> DataFrame:
    """Inner join of rows with keyed, which has one row for each key and the key's number of rows in `count`.

    total: the number of rows.  Hot keys, at most HOT of them, come by broadcast, so their rows stay where they are; only
    the rows of other keys are shuffled.  hint: how these are joined, where keyed is known to grow with rows.
    """
    least = max(total / HOT, 1)
    hot = keyed.where(F.col(count) > least)
    near = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    others = keyed.where(F.col(count) <= least)
    return near.unionByName(rest.join(others.hint(hint) if hint else others, key))


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b longs): root is the smallest node that it can reach.

    Alternates large and small stars (each node points its larger, then its smaller neighbours at the least one it knows),
    which ends in stars around the roots after about log(n) rounds.  Every round is written to the shared folder.  A node
    with very many neighbours gets its least one by broadcast, so its edges are never gathered in one task.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before, total = None, e.count()
    for _ in range(most_rounds if total else 0):
        # large star, from both ends: b is seen from its larger neighbours, and a from its smaller ones
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = join_spread(both.where("b > a"), least, "a", "n", 2 * total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), name)
        # now every edge points from a larger to a smaller node
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hops = join_spread(large, low, "a", "n", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = low.select("a", F.col("m").alias("b")).unionByName(hops).where("a > b").distinct()
        e = materialize(small, name)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before, total = now, now[0]
    else:
        if total:
            raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
