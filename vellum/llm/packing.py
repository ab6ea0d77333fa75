"""Filling containers of one capacity by the sum-of-squares rule."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items that one packer places. Its containers left open waste a share that falls with this number.
BLOCK = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, in the order given; sizes from 1 to ``capacity``.

    ``level[h]`` counts open containers filled to h. Each item goes where the sum of the squared counts
    grows least, into a container just as full or a new one; the fullest wins ties.
    """
    level = np.zeros(capacity + 1, "i8")
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, n = np.empty(len(sizes), "i8"), 0
    for i, s in enumerate(sizes.tolist()):
        h = np.flatnonzero(level[1 : capacity - s + 1]) + 1
        best, new = None, 0 if s == capacity else 2 * int(level[s]) + 1
        if len(h):
            gain = 2 * (level[h + s] - level[h]) + 2
            if h[-1] + s == capacity:  # closes: no level gains
                gain[-1] = 1 - 2 * level[h[-1]]
            j = len(h) - 1 - int(gain[::-1].argmin())
            if gain[j] <= new:
                best = int(h[j])
        if best is None:
            c, n, best = n, n + 1, 0
        else:
            c = at[best].pop()
            level[best] -= 1
        if best + s < capacity:
            at[best + s].append(c)
            level[best + s] += 1
        out[i] = c
    return out


def pack(sizes: DataFrame, item_id: str, tokens: str, *, capacity: int = 2048, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """``container_id, item_id, piece_no, first_token, tokens``: where each item lies.

    An item up to the capacity lies whole in one container. A longer one fills containers of its own; what
    is left over is placed as an item. Items of null, zero or negative size
    take no container and don't come out. Items are parted by hash into groups of about
    ``block``, each packed by itself in hash order, so the result is the same however rows
    arrive. Items must be unique.
    """
    items = sizes.select(F.col(item_id).alias("item_id"), F.col(tokens).cast("long").alias("size")).where("item_id is not null and size > 0")
    groups = max(1, -(-items.count() // block))
    placed = items.withColumn("h", F.xxhash64("item_id", F.lit(seed))).withColumn("g", F.pmod("h", F.lit(groups)))
    kind = items.schema["item_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "item_id"], kind="stable")
        size = pdf["size"].to_numpy()
        whole, rest = size // capacity, size % capacity
        n = len(pdf)
        own = np.repeat(np.arange(n), whole)
        piece = np.arange(len(own)) - np.repeat(np.cumsum(whole) - whole, whole)
        some = np.flatnonzero(rest)
        c = sum_of_squares(rest[some], capacity)
        top = int(c.max()) + 1 if len(c) else 0
        row, part = np.r_[some, own], np.r_[whole[some], piece]
        return pd.DataFrame(
            {
                "container_id": (int(key[0]) << 32) + np.r_[c, top + np.arange(len(own))],
                "item_id": pdf["item_id"].to_numpy()[row],
                "piece_no": part,
                "first_token": part * capacity,
                "tokens": np.r_[rest[some], np.full(len(own), capacity)],
            }
        )

    return placed.groupBy("g").applyInPandas(run, f"container_id long, item_id {kind}, piece_no long, first_token long, tokens long")


def containers(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``container_id, items, used, unused`` of each container."""
    return placed.groupBy("container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("used")).withColumn("unused", F.lit(capacity) - F.col("used"))


def fill_report(placed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, unused space and its share, and the least number of containers that could do."""
    used = F.sum("used")
    return containers(placed, capacity).agg(
        F.count("*").alias("containers"), F.coalesce(used, F.lit(0)).alias("tokens"), F.coalesce(F.sum("unused"), F.lit(0)).alias("unused"), F.round(F.sum("unused") / (F.count("*") * capacity), 6).alias("unused_share"), F.coalesce(F.ceil(used / capacity), F.lit(0)).alias("least_containers")
    )
