"""Which artifacts are sound, when each is bound to the hashes of those that it was made from.

A link is broken if its parent is not there or has another hash. An artifact is sound if
all its links hold and all its parents are sound, so soundness spreads from artifacts
without links; each round takes the links of what has just become sound, so every link is
read once, and there are as many rounds as the longest chain of links. What is left
depends on a broken link, or on a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import dropped, saved


def broken_links(artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """``links(child, parent, bound)`` with problem: missing_child, missing_parent, hash_differs, or null if it holds."""
    own = artifacts.select(F.col("id").alias("parent"), F.col("hash").alias("parent_hash"), F.lit(True).alias("there"))
    kids = artifacts.select(F.col("id").alias("child"), F.lit(True).alias("known")).distinct()
    both = links.join(own, "parent", "left").join(kids, "child", "left")
    problem = F.when(F.col("known").isNull(), "missing_child").when(F.col("there").isNull(), "missing_parent").when(~F.col("bound").eqNullSafe(F.col("parent_hash")) | F.col("bound").isNull(), "hash_differs")
    return both.select("child", "parent", "bound", problem.alias("problem"))


class _Grown:
    """A table that grows by one written piece a round; pieces are rewritten as one now and then, so plans stay short."""

    MOST = 16

    def __init__(self, first: DataFrame):
        self.pieces = [saved(first)]
        self.spent: list[DataFrame] = [self.pieces[0]]

    def add(self, piece: DataFrame, table: DataFrame) -> None:
        """``piece``, read from the written ``table``."""
        self.pieces.append(piece)
        if table not in self.spent:
            self.spent.append(table)
        if len(self.pieces) > self.MOST:
            whole = saved(self.all())
            for old in self.spent[:-1]:  # the last may still be read
                dropped(old)
            self.pieces, self.spent = [whole], [self.spent[-1], whole]

    def all(self) -> DataFrame:
        out = self.pieces[0]
        for piece in self.pieces[1:]:
            out = out.unionByName(piece)
        return out


def _spread(start: DataFrame, links: DataFrame) -> DataFrame:
    """id of ``start(id)`` and of all that depend on them."""
    seen = _Grown(start.select("id").distinct())
    front = seen.pieces[0]
    while True:
        more = links.join(front, F.col("parent") == F.col("id"), "left_semi").select(F.col("child").alias("id")).distinct()
        front = saved(more.join(seen.all(), "id", "left_anti"))
        if front.isEmpty():
            return seen.all()
        seen.add(front, front)


def soundness(artifacts: DataFrame, links: DataFrame) -> DataFrame:
    """id, status, problem, level of every artifact of ``artifacts(id, hash)``, bound by ``links(child, parent, bound)``.

    status: ``sound``; ``broken`` (a link of its own is, ``problem`` lists why, sorted);
    ``depends`` on a broken one; ``cycle``: in a cycle, or depends on one and on nothing
    broken. level: links to the farthest root, of sound ones.
    """
    checked = saved(broken_links(artifacts, links))
    bad = checked.where("problem is not null and problem <> 'missing_child'").groupBy(F.col("child").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("problem")), ",").alias("problem"))
    bad = saved(bad)
    good = checked.where("problem is null").select("child", "parent").distinct()
    wanted = saved(good.groupBy("child").agg(F.count("*").alias("wanted")).join(bad, F.col("child") == F.col("id"), "left_anti"))
    ids = artifacts.select("id").distinct()
    has_links = checked.select(F.col("child").alias("id")).distinct()
    sound = _Grown(ids.join(has_links, "id", "left_anti").withColumn("level", F.lit(0)))
    front = sound.pieces[0]
    # How many parents of each artifact that still waits are sound by now.
    have = wanted.select("child", "wanted", F.lit(0).cast("bigint").alias("have"))
    level = 0
    while True:
        level += 1
        met = good.join(front, F.col("parent") == F.col("id")).groupBy("child").agg(F.count("*").alias("more"))
        now = saved(have.join(met, "child", "left").select("child", "wanted", (F.col("have") + F.coalesce("more", F.lit(0))).alias("have")))
        front = now.where("have = wanted").select(F.col("child").alias("id"), F.lit(level).alias("level"))
        if front.isEmpty():
            break
        sound.add(front, now)
        have = now.where("have < wanted")
    behind = _spread(bad, good)
    out = ids.join(sound.all(), "id", "left").join(bad, "id", "left").join(behind.withColumn("behind", F.lit(True)), "id", "left")
    status = F.when(F.col("level").isNotNull(), "sound").when(F.col("problem").isNotNull(), "broken").when(F.col("behind"), "depends").otherwise("cycle")
    return out.select("id", status.alias("status"), "problem", "level")
