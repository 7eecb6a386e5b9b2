"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Equal texts form a group that must stay together.  Groups are dealt by a hash to cells of a
bounded number.  A cell sorts its groups by size and cuts them into levels of half the bytes, a
quarter and so on; each level repeatedly combines its two partial partitions with the largest
spread, oppositely ordered, until one partition into ``shards`` loads, the level's pieces, is
left.  A group larger than an average cell's share of a shard cannot be balanced inside a cell
and is a piece of its own.  The pieces of all cells and the large groups are then differenced
together on the driver, so that small pieces fill up what large groups leave; it sees at most
``most_cells * shards`` pieces of the cells and ``shards * max(coarse, cells)`` large groups.

A row's slot is the number of rows before it in its shard.  Rows are counted by shard and by
a hash bucket of the key; the counts give each bucket its first slot and a window numbers the
rows inside one bucket, so no shard's rows meet in one task.

Defined results: a null text is the empty text (size 1, checksum 0) and belongs to the group
of empty texts.  Repeated rows are placed each.  An empty table gives no row.  A group of more
than an eighth of all bytes makes its shard as large as itself, as the law of groups demands.
Only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import staged


def difference(parts: list[list[tuple[int, list]]], shards: int) -> list[tuple[int, list]]:
    """Combine partial partitions (lists of load and content) until one is left.

    Each combination takes the two of largest spread and joins the heaviest bin of one with
    the lightest of the other.  The result is sorted from the heaviest bin to the lightest.
    """
    heap = []
    for number, bins in enumerate(parts):
        bins = sorted(bins, key=lambda b: -b[0])
        heap.append((bins[-1][0] - bins[0][0], number, bins))
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # contents are linked as pairs, so that joining two bins takes constant time
        bins = sorted(((x + y, (p, q)) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda z: -z[0])
        heapq.heappush(heap, (bins[-1][0] - bins[0][0], number, bins))
        number += 1
    return heap[0][2] if heap else [(0, None)] * shards


def contents(linked) -> Iterator:
    """The items of a bin of ``difference``; an item is anything but a pair or None."""
    stack = [linked]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        elif x is not None:
            yield x


def single(load: int, item, shards: int) -> list[tuple[int, object]]:
    return [(load, item)] + [(0, None)] * (shards - 1)


def by_bytes(
    docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", cell_groups: int = 20_000, most_cells: int = 20_000,
    coarse: int = 64, slot_buckets: int = 512,
) -> DataFrame:
    """One row for each of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = staged(
        docs.select(
            F.col(key).alias("__key"), (F.octet_length(content).cast("long") + 1).alias("size"), F.crc32(content).alias("text_crc32"),
            F.unhex(F.md5(content)).alias("group"),
        ),
        "shard-rows",
    )
    summed = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    n_rows, total = rows.agg(F.count("*"), F.sum("size")).first()
    cells = max(1, min(most_cells, math.ceil(n_rows / cell_groups)))
    groups = staged(summed.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells)).cast("int")), "shard-groups")
    levels = max(1, min(14, most_cells // cells))
    large_from = (total or 0) / (shards * max(coarse, cells))
    large = [(r["bytes"], bytes(r["group"])) for r in groups.where(F.col("bytes") > large_from).select("bytes", "group").collect()]

    def cell_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "group"], ascending=[False, True], ignore_index=True)
        sizes = pdf["bytes"].to_numpy()
        left = sizes[::-1].cumsum()[::-1]
        level = np.minimum(levels - 1, np.log2(left[0] / left).astype(int))
        label = np.zeros(len(sizes), dtype=np.int32)
        for k in np.unique(level):
            parts = [single(int(sizes[i]), int(i), shards) for i in np.flatnonzero(level == k)]
            for place, (_, linked) in enumerate(difference(parts, shards)):
                label[list(contents(linked))] = k * shards + place
        return pd.DataFrame({"group": pdf["group"], "bytes": pdf["bytes"], "cell": pdf["cell"], "label": label})

    small = groups.where(F.col("bytes") <= large_from).groupBy("cell").applyInPandas(cell_pieces, "group binary, bytes long, cell int, label int")
    labelled = staged(small, "shard-labels")
    loads = labelled.groupBy("cell", "label").agg(F.sum("bytes").alias("load")).collect()
    items = [*large, *((r["load"], r["cell"] * levels * shards + r["label"]) for r in loads)]
    items.sort(key=lambda x: (-x[0], isinstance(x[1], int), x[1]))
    where, of_large = [], []
    for shard, (_, linked) in enumerate(difference([single(load, x, shards) for load, x in items], shards)):
        for x in contents(linked):
            if isinstance(x, int):
                where.append((*divmod(x, levels * shards), shard))
            else:
                of_large.append((bytearray(x), shard))
    # at most most_cells * shards small rows
    places = spark.createDataFrame(where, "cell int, label int, shard int")
    shard_of = labelled.join(F.broadcast(places), ["cell", "label"]).select("group", "shard")
    if of_large:
        shard_of = shard_of.unionByName(spark.createDataFrame(of_large, "group binary, shard int"))
    bucket = F.pmod(F.xxhash64(F.col("__key").cast("string"), F.lit("slot")), F.lit(slot_buckets)).cast("int")
    dealt = staged(rows.join(shard_of, "group").select("__key", "size", "text_crc32", "shard", bucket.alias("bucket")), "shard-dealt")
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))  # at most shards * slot_buckets rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("__key", "text_crc32", "size")
    return (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(first), ["shard", "bucket"])
        .select(
            F.col("__key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
