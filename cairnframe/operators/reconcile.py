"""Desired state against actual state: what a heartbeat's answer asks a server to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BROKEN
from .joins import join_dimension


def actions(response: DataFrame, local: DataFrame, groups: DataFrame | None = None, versions: list[int] | None = None) -> DataFrame:
    """ext_id, action: one row for every extent on either side.

    ``response`` has ext_id, state, created, group_id, version and new_source (it carries a clone job that is new); ``groups`` the known
    group_id.  One action per row:

    create, skip (group or version unknown), broken (not here, but created before), replace (here and broken: delete, leave a
    placeholder), clone_source (update, then export), update, delete (the other side does not know it).
    """
    theirs = response.select("ext_id", F.lit(True).alias("wanted"), "state", "created", "group_id", "version", "new_source")
    if groups is not None:
        theirs = join_dimension(theirs, groups.select("group_id").distinct().withColumn("known", F.lit(True)), "group_id", "left")
    else:
        theirs = theirs.withColumn("known", F.lit(True))
    both = theirs.join(local.select("ext_id").distinct().withColumn("here", F.lit(True)), "ext_id", "full_outer")
    fresh = F.col("created") == 0
    able = F.coalesce("known", F.lit(False)) & (F.col("version").isin(versions) if versions is not None else F.lit(True))
    action = (
        F.when(F.col("wanted").isNull(), "delete")
        .when(F.col("here").isNull() & fresh & able, "create")
        .when(F.col("here").isNull() & fresh, "skip")
        .when(F.col("here").isNull(), "broken")
        .when(F.col("state") == BROKEN, "replace")
        .when(F.col("new_source"), "clone_source")
        .otherwise("update")
    )
    return both.select("ext_id", action.alias("action"))


def meta_update(extents: DataFrame, response: DataFrame) -> DataFrame:
    """Extents with what the control plane says of them: a broken state stays, otherwise theirs wins where it is set."""
    theirs = response.select("ext_id", F.col("state").alias("new_state"))
    out = extents.join(theirs, "ext_id", "left")
    return out.withColumn("state", F.when(F.col("state") == BROKEN, F.col("state")).otherwise(F.coalesce("new_state", "state"))).drop("new_state")


def broken_disks(extents: DataFrame, disks: DataFrame) -> DataFrame:
    """Extents, broken where their disk is."""
    bad = disks.where(F.col("state") == "Broken").select("disk_id").distinct().withColumn("bad", F.lit(True))
    out = join_dimension(extents, bad, "disk_id", "left")
    return out.withColumn("state", F.when(F.col("bad"), BROKEN).otherwise(F.col("state"))).drop("bad")


def heartbeat(disks: DataFrame, extents: DataFrame) -> DataFrame:
    """What a server reports per disk: state, size, used, and its extents by number and available bytes."""
    per = extents.groupBy("disk_id").agg(F.count("*").alias("n_extents"), F.sum("avail").alias("avail"), F.count_if(F.col("state") == BROKEN).alias("n_broken"))
    zero = F.lit(0).cast("long")
    out = disks.join(per, "disk_id", "left")
    return out.select("disk_id", "state", "size", "used", F.coalesce("n_extents", zero).alias("n_extents"), F.coalesce("avail", zero).alias("avail"), F.coalesce("n_broken", zero).alias("n_broken"))


def fits(disks: DataFrame, wanted: int) -> DataFrame:
    """Disks with whether an extent of ``wanted`` bytes still fits, and the error if not."""
    free = F.col("size") - F.col("used")
    return disks.withColumn("free", free).withColumn("err", F.when(F.lit(wanted) > free, F.lit("NoSpace")))
