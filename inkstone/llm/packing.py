"""Items of varying length put into containers of fixed capacity.

Packing is hierarchical.  First every partition packs its own items best-fit,
longest first.  Containers that are nearly full are final.  The others go to
fewer partitions, where they are merged by best fit with those of their
neighbours, and so on up the tree, until they all have met in one partition,
nothing is left to merge, or a round saves next to none.  A container that is
merged is opened, for whole ones that are nine tenths full fit with no other.  As many partitions are kept as there are ``TASK_ITEMS`` items for,
and no task packs more than that at a time, so the work is spread and bounded.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.runtime import materialize

CAPACITY = 4096
#: A container is final once it is so full.
NEARLY_FULL = 0.998
#: Items for one task, how many partitions merge into one from round to round, and the least number to begin with.
TASK_ITEMS, FAN_IN, LEAST_PACKS = 100_000, 8, 8
#: Share of the underfull containers that a round has to save for another one to follow.
LEAST_GAIN = 0.001


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """The container of each item and the fill of each container, by best fit, longest first.

    Ties go to the earlier item.  Items of size 0 go into the fullest container.
    """
    where, fill = [0] * len(sizes), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by free space
    frees: list[int] = []  # free spaces in use, in order
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        k = bisect.bisect_left(frees, s)
        if k < len(frees):
            free = frees[k]
            b = room[free].pop()
            if not room[free]:
                frees.pop(k)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        where[i] = b
        fill[b] += s
        left = free - s
        if not room[left]:
            bisect.insort(frees, left)
        room[left].append(b)
    return where, fill


def _round(items: DataFrame, capacity: int, level: int) -> DataFrame:
    """(item, size, container, fill) by best fit within each partition, at most ``TASK_ITEMS`` items at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = 0

        def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            sizes = table.column(1).to_pylist()
            where, fill = best_fit(sizes, capacity)
            label = f"{level}-{TaskContext.get().partitionId()}-{block}-"
            out = table.append_column("container", pa.array([f"{label}{b}" for b in where], pa.string())).append_column("fill", pa.array([fill[b] for b in where], pa.int32()))
            return iter(out.combine_chunks().to_batches(50_000))

        open_: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            while held + batch.num_rows >= TASK_ITEMS:
                take = TASK_ITEMS - held
                yield from packed(pa.Table.from_batches([*open_, batch.slice(0, take)]))
                open_, held, block, batch = [], 0, block + 1, batch.slice(take)
            if batch.num_rows:
                open_.append(batch)
                held += batch.num_rows
        if open_:
            yield from packed(pa.Table.from_batches(open_))

    # in order, so that a task that is tried again packs alike; Spark sorts, and spills, and Python holds one block
    return items.sortWithinPartitions("item").mapInArrow(run, "item string, size int, container string, fill int")


def pack(items: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, part, first, size, container, fill): every item's place.

    ``items`` has a unique key and a size of at least 0; null sizes count as 0.
    An item above the capacity is cut into parts: full ones, each a container of
    its own, and the rest, which is packed like any item.  Other items have the
    one part 0.  ``first`` is where the part begins in the item.  An empty table
    gives no rows.
    """
    n = F.coalesce(F.col(size), F.lit(0))
    parts = materialize(
        items.select(F.col(key), n.cast("int").alias("_n"))
        .select(key, "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / capacity) - 1, F.lit(0)).cast("int"))).alias("part"))
        .select(key, "part", (F.col("part") * capacity).cast("int").alias("first"), F.least(F.col("_n") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("size")),
        "pack-parts",
    )
    name = F.concat_ws("#", F.col(key).cast("string"), F.col("part").cast("string"))
    rest = parts.where(F.col("size") < capacity).select(name.alias("item"), "size")
    count = rest.count()
    partitions = max(LEAST_PACKS, math.ceil(count / TASK_ITEMS))
    enough = capacity * NEARLY_FULL
    placed = materialize(_round(rest.repartition(partitions, F.xxhash64("item")), capacity, 0), "pack-0")
    level, out, loose = 0, placed.where(F.col("fill") >= enough), placed.where(F.col("fill") < enough)
    while partitions > 1:
        held = loose.agg(F.count("*"), F.count_distinct("container")).first()
        if held[1] < 2:
            break
        level, partitions = level + 1, max(math.ceil(partitions / FAN_IN), math.ceil(held[0] / TASK_ITEMS))
        merged = materialize(_round(loose.select("item", "size").repartition(partitions, F.xxhash64("item")), capacity, level), f"pack-{level}")
        saved = held[1] - merged.select("container").distinct().count()
        if saved >= 0:
            out, loose = out.unionByName(merged.where(F.col("fill") >= enough)), merged.where(F.col("fill") < enough)
        if saved < LEAST_GAIN * held[1] and partitions > 1:
            break
    out = out.unionByName(loose).select("item", "container", "fill")
    full = parts.where(F.col("size") >= capacity).select(key, "part", "first", "size", F.concat(F.lit("full-"), name).alias("container"), F.col("size").alias("fill"))
    return parts.where(F.col("size") < capacity).withColumn("item", name).join(out, "item").select(key, "part", "first", "size", "container", "fill").unionByName(full)


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, tokenizers: str | None = None) -> DataFrame:
    """``pack`` of the texts of ``documents``, sized in tokens."""
    from inkstone.llm.tokens import TOKENIZERS, encode

    return pack(encode(docs, tokenizers or TOKENIZERS, counts_only=True), capacity)

