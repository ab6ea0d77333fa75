"""Changes between full snapshots: EXCEPT ALL both ways, residues joined by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delivered_versions(df: DataFrame, snapshot: str, key: Column, latest: Sequence[Column], values: dict[str, Column]) -> DataFrame:
    """One row per (snapshot, key): the version delivered last.

    ``latest`` orders versions, the greatest wins; the values themselves break
    the last ties, so equal deliveries give the same row on every run. Rows
    without snapshot or key are dropped. The choice is a ``max`` over a
    struct, so it is combined before the shuffle however often one key was
    delivered.
    """
    cols = {"snapshot": F.col(snapshot), "path_key": key, **{f"v_{k}": v for k, v in values.items()}}
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(latest)], *[v.alias(f"v_{k}") for k, v in values.items()])
    return (
        df.select(cols["snapshot"].alias("snapshot"), key.alias("path_key"), rank.alias("r"))
        .where(F.col("snapshot").isNotNull() & F.col("path_key").isNotNull())
        .groupBy("snapshot", "path_key")
        .agg(F.max("r").alias("r"))
        .select("snapshot", "path_key", *[F.col(f"r.v_{k}").alias(k) for k in values])
    )


def snapshot_changes(versions: DataFrame, deliveries: DataFrame | None = None) -> DataFrame:
    """Label what each snapshot added, removed or changed against the one before.

    ``versions``: ``snapshot, path_key`` and value columns, one row per key and
    snapshot. ``deliveries`` (column ``snapshot``): all snapshots that arrived,
    also those without a single usable row; default: those in ``versions``. Every snapshot is compared with the delivered one
    before it, whatever gaps the numbers have; the first yields nothing.
    Identical rows vanish in EXCEPT ALL, run both ways; what is left is
    full-joined by key: only new = added, only old = removed, both = changed.
    Null values compare as equal to null. An empty input gives no rows.
    """
    values = [c for c in versions.columns if c not in ("snapshot", "path_key")]
    # one row per snapshot, a count of deliveries and not of records
    snaps = (versions if deliveries is None else deliveries).select("snapshot").distinct()
    order = snaps.select("snapshot", F.lead("snapshot").over(Window.orderBy("snapshot")).alias("next")).where("next is not null")
    # the later side carries its own number, the earlier one that of its successor
    new = versions.join(order.select(F.col("next").alias("snapshot")), "snapshot", "left_semi").select("snapshot", "path_key", *values)
    old = versions.join(order, "snapshot").select(F.col("next").alias("snapshot"), "path_key", *values)
    here = new.exceptAll(old).select("snapshot", "path_key", F.lit(True).alias("is_new"))
    gone = old.exceptAll(new).select("snapshot", "path_key", F.lit(True).alias("is_old"))
    return here.join(gone, ["snapshot", "path_key"], "full_outer").select(
        "snapshot",
        "path_key",
        F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "removed").otherwise("changed").alias("change_type"),
    )
