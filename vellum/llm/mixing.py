"""Mixing sources to target shares by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.plans.shared import written

#: Records in one block of a source's order, about.
BLOCK = 20_000
#: Steps of virtual time that the crossing of the budget is looked for in.
STEPS = 4096


def plan_mix(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, weight, target_share, max_repeat, available, records``: what the mix can draw on.

    ``sizes``: ``source, tokens``; ``targets``: ``source_name, target_share, max_repeat``. Null
    or negative shares and names count as no target, a null or smaller max_repeat as 1; of
    repeated targets the greatest holds. Weights are the shares of the sources that have records, scaled to sum 1.
    """
    t = targets.where("source_name is not null and target_share > 0 and not isnan(target_share)").groupBy(F.col("source_name").alias("source")).agg(F.max("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeat", F.lit(1)), F.lit(1))).alias("max_repeat"))
    have = sizes.where("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("records"))
    joined = t.join(have, "source", "left").withColumns({"available": F.coalesce("available", F.lit(0)), "records": F.coalesce("records", F.lit(0))})
    served = F.when(F.col("available") > 0, F.col("target_share")).otherwise(0.0)
    # as many rows as there are targets
    return joined.withColumn("weight", F.coalesce(served / F.nullif(F.sum(served).over(Window.partitionBy()), F.lit(0.0)), F.lit(0.0)))


def mix(sizes: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 13, block: int = BLOCK) -> DataFrame:
    """``item_id, source, copy, tokens, finish``: the chosen records and how often each is drawn.

    ``sizes``: ``item_id, source, tokens``. Each source's records, in hash order, queue up once for
    each repeat allowed. A record's finish time is the source's tokens up to and with it, divided by the
    source's weight; records are taken by finish time until the next would exceed
    ``budget`` tokens. The default is the largest budget at which no source with
    records runs out before it has its share. Above it, sources that run out leave their share to the others.
    Records without id, source, target or tokens are left out. No record, or no target, gives no rows.
    """
    sizes = sizes.where("item_id is not null and tokens > 0")
    plan = written(plan_mix(sizes, targets).where("weight > 0"), "mix-plan")
    top = plan.agg(F.min(F.col("available") * F.col("max_repeat") / F.col("weight")).alias("budget"), F.sum("records").alias("n")).first()
    limit = float(budget) if budget is not None else float(top["budget"] or 0)
    blocks = max(1, -(-int(top["n"] or 0) // block))

    keyed = sizes.join(plan.select("source", "weight", "max_repeat", "available"), "source").withColumn("h", F.xxhash64("item_id", F.lit(seed))).withColumn("block", F.pmod("h", F.lit(blocks)))
    # prefix sums in two steps, so that no source is walked by one task
    sums = keyed.groupBy("source", "block").agg(F.sum("tokens").alias("t"))
    before = sums.select("source", "block", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("h", "item_id").rowsBetween(Window.unboundedPreceding, 0))
    served = keyed.withColumn("within", within).join(before, ["source", "block"])
    passes = served.select("item_id", "source", "tokens", "weight", "available", (F.col("within") + F.col("before")).alias("sofar"), F.explode(F.sequence(F.lit(1), F.col("max_repeat"))).alias("copy"))
    queue = written(passes.select("item_id", "source", "copy", "tokens", (((F.col("copy") - 1) * F.col("available") + F.col("sofar")) / F.col("weight")).alias("finish")), "mix-queue")

    # where the budget is crossed: first the step of virtual time, then the record
    last = queue.agg(F.max("finish")).first()[0] or 1.0
    step = F.least(F.floor(F.col("finish") / F.lit(last) * STEPS), F.lit(STEPS))
    steps = queue.groupBy(step.alias("step")).agg(F.sum("tokens").alias("t"))
    cum = steps.withColumn("upto", F.sum("t").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)))
    cut = cum.where(F.col("upto") > limit).orderBy("step").select("step", (F.col("upto") - F.col("t")).alias("taken")).first()
    if cut is None:
        return queue
    # within one step: again in steps, until it is fine enough to order
    at, taken, lo, hi = int(cut["step"]), int(cut["taken"]), 0.0, float(last)
    low = lo + (hi - lo) * at / STEPS
    high = lo + (hi - lo) * (at + 1) / STEPS
    edge = queue.where((step == at)).repartitionByRange("finish", "source", "item_id", "copy")
    order = Window.orderBy("finish", "source", "item_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    fine = F.floor((F.col("finish") - low) / max(high - low, 1e-300) * STEPS)
    sub = edge.groupBy(fine.alias("fine")).agg(F.sum("tokens").alias("t")).withColumn("upto", F.lit(taken) + F.sum("t").over(Window.orderBy("fine").rowsBetween(Window.unboundedPreceding, 0)))
    inner = sub.where(F.col("upto") > limit).orderBy("fine").select("fine", (F.col("upto") - F.col("t")).alias("taken")).first()
    some = edge.where(fine < inner["fine"]).select(queue.columns)
    # a 16-millionth of the queue is put in order
    rest = edge.where(fine == inner["fine"]).withColumn("upto", F.lit(int(inner["taken"])) + F.sum("tokens").over(order)).where(F.col("upto") <= limit).select(queue.columns)
    return queue.where(step < at).unionByName(some).unionByName(rest)


def shares(chosen: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Wanted and actual share of each target source; a target without records has none."""
    plan = plan_mix(sizes, targets)
    got = chosen.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.max("copy").alias("most_copies"))
    total = F.nullif(F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy()), F.lit(0))
    return plan.join(got, "source", "left").select(
        F.col("source").alias("source_name"),
        "target_share",
        F.round("weight", 6).alias("wanted_share"),
        F.coalesce(F.round(F.coalesce("tokens", F.lit(0)) / total, 6), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        "max_repeat",
        F.col("available").alias("available_tokens"),
    )
