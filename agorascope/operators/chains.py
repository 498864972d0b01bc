"""Version links followed by pointer doubling: roots and distances, and the faults a list of links can have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.session import stored


def follow(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each id's links lead: (id, root_id, steps) of those that reach an end, (id, cycle_id, in_cycle) of the rest.

    ``links`` has one row an id, with ``up``, an id or NULL at an end. Each round joins the open ids with what they point
    to, so links are followed 1, 2, 4, ... steps; a round that settles nothing leaves only ids that lead into cycles.
    These go on until a round neither narrows the ids pointed to nor lowers a smallest id: ids that are mapped onto themselves
    are the cycles' own, and the smallest id seen on the way from one of them is its cycle's smallest. So rounds grow with the
    logarithm of the longest path, not of the number of ids. Rounds are read back from files, whose sizes are known: the estimated
    size of a join is a product, and over checkpoints these products would themselves fill the driver.
    """
    start = links.select(
        "id", F.col("up").alias("to"), F.when(F.col("up").isNull(), F.col("id")).alias("root_id"),
        F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("steps"), F.least("id", F.coalesce("up", "id")).alias("low"),
    )
    start = stored(start, "links-start")
    done = start.filter(F.col("to").isNull()).select("id", "root_id", "steps")
    waiting = start.filter(F.col("to").isNotNull()).select("id", "to", "steps", "low")
    left, pointed = _open(waiting)
    while left:
        ends = done.select(F.col("id").alias("to"), F.col("root_id").alias("_root"), F.col("steps").alias("_s"))
        ahead = waiting.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_n"), F.col("low").alias("_low"))
        met = stored(waiting.join(ends, "to", "left").join(ahead, "to", "left"), "links-met")
        done = done.union(met.filter("_root IS NOT NULL").select("id", "_root", F.col("steps") + F.col("_s")))
        still = met.filter("_root IS NULL")
        waiting = still.select("id", F.col("_to").alias("to"), (F.col("steps") + F.col("_n")).alias("steps"), F.least("low", "_low").alias("low"))
        before, (left, pointed) = (left, pointed), _open(waiting)
        if before == (left, pointed) and still.filter("_low < low").isEmpty():
            break
    own = waiting.select(F.col("to").alias("id")).distinct()
    smallest = waiting.join(own, "id", "left_semi").select(F.col("id").alias("to"), F.col("low").alias("cycle_id"))
    lost = waiting.select("id", "to").join(smallest, "to").select("id", "cycle_id")
    members = smallest.select(F.col("to").alias("id"), F.lit(True).alias("in_cycle"))
    return done, lost.join(members, "id", "left").select("id", "cycle_id", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


def _open(waiting: DataFrame) -> tuple[int, int]:
    """How many ids wait, and how many ids they point to."""
    per = waiting.groupBy("to").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("to")).first()
    return per.n or 0, per.to


def chain_audit(stories: DataFrame) -> DataFrame:
    """Every version with where its links lead and what is wrong with its own link.

    ``root_id`` and ``steps`` follow ``previous_version_id`` to its end (NULL where it runs into a cycle, whose smallest id is
    ``cycle_id``). ``dangling``: it names no version, and the chain ends here. ``cross_slug``, ``wrong_version``: it names another
    slug's version, or one that is not the version before. ``successors`` above one are a fork. Of several rows of an id the one
    with the smallest link counts.
    """
    columns = ["id", "slug", "version", "previous_version_id"]
    first = stories.groupBy("id").agg(F.min(F.struct("previous_version_id", "slug", "version")).alias("m"))
    rows = stored(first.select("id", "m.slug", "m.version", "m.previous_version_id").select(*columns), "versions")
    prior = rows.select(F.col("id").alias("previous_version_id"), F.col("slug").alias("_slug"), F.col("version").alias("_version"), F.lit(True).alias("_there"))
    linked = stored(rows.join(prior, "previous_version_id", "left").withColumn("up", F.when(F.col("_there"), F.col("previous_version_id"))), "links")
    reached, lost = follow(linked.select("id", "up"))
    after = linked.filter("up IS NOT NULL").groupBy("up").agg(F.count(F.lit(1)).alias("successors")).withColumnRenamed("up", "id")
    has = F.col("up").isNotNull()
    out = linked.join(reached, "id", "left").join(lost, "id", "left").join(after, "id", "left")
    return out.select(
        "id", "slug", "version", "root_id", "steps", "cycle_id", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
        F.coalesce("successors", F.lit(0)).cast("long").alias("successors"), (~has & F.col("previous_version_id").isNotNull()).alias("dangling"),
        (has & ~F.col("_slug").eqNullSafe(F.col("slug"))).alias("cross_slug"), (has & ~F.col("version").eqNullSafe(F.col("_version") + 1)).alias("wrong_version"),
    )


def faulty_chains(stories: DataFrame) -> DataFrame:
    """Slugs with any fault of the audit: how many versions of each kind, and how many versions have no root."""
    rows = chain_audit(stories)
    counts = rows.groupBy("slug").agg(
        F.count(F.lit(1)).alias("versions"), F.count_if(F.col("cycle_id").isNotNull()).alias("rootless"), F.count_if("in_cycle").alias("in_cycles"),
        F.count_if(F.col("successors") > 1).alias("forks"), F.count_if("dangling").alias("dangling"), F.count_if("cross_slug").alias("cross_slug"), F.count_if("wrong_version").alias("wrong_version"),
    )
    faults = [F.col(c) for c in ("rootless", "forks", "dangling", "cross_slug", "wrong_version")]
    return counts.filter(sum(faults[1:], faults[0]) > 0)
