"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts form an indivisible group. The differencing method repeatedly takes the two partial
partitions with the largest spread and adds them in opposite order, so that the largest part of one meets the smallest
of the other. Run over all groups at once it would be a single sequential heap, so it runs in three levels:

1. light groups are dealt by hash into cells of about ``CELL_GROUPS`` groups; each cell is differenced into
   ``MICRO`` parts on its own (one task a cell, bounded memory);
2. the cells' partial partitions are differenced with one another, ``FAN_IN`` at a time, until one remains;
3. the ``MICRO`` parts and the heavy groups (those above 1/``MICRO`` of all bytes; there are fewer than ``MICRO``) are
   differenced into the shards on the driver: at most 2 * ``MICRO`` items at any input size.

Defined results: a null text counts as empty (size 16, crc 0) and shares the group of empty texts; repeated rows are
rows like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, materialise, salted_left_join

OVERHEAD = 16
CELL_GROUPS = 8_000
MICRO = 800
FAN_IN = 256
#: A text with more than this share of all rows counts as hot when groups are joined back to rows.
HOT_SHARE = 0.01


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine n partial partitions into one. ``parts``: n by k sums. Gives the k sums and an n by k table that says
    which final part each part went to. Ties are broken by position, so the result depends on ``parts`` alone."""
    n, k = parts.shape
    if n == 0:
        return np.zeros(k, np.int64), np.zeros((0, k), np.int64)
    heap, sums, inside = [], {}, {}
    for i in range(n):
        order = np.argsort(parts[i], kind="stable")
        sums[i] = parts[i][order]
        # a list of (leaf, permutation) would cost n * k at each step: keep a binary tree and resolve it at the end
        inside[i] = order
        heap.append((-int(sums[i][-1] - sums[i][0]), i))
    heapq.heapify(heap)
    tree, new = {}, n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(total, kind="stable")
        sums[new], tree[new] = total[order], (a, b, order)
        heapq.heappush(heap, (-int(sums[new][-1] - sums[new][0]), new))
        new += 1
    root = heap[0][1]
    place, where = {root: np.arange(k)}, np.zeros((n, k), np.int64)
    for node in range(root, -1, -1):
        if node not in place:
            continue
        at = place.pop(node)  # at[j]: the final part of this node's j-th smallest part
        if node < n:
            where[node][inside[node]] = at
        else:
            a, b, order = tree[node]
            back = np.empty(k, np.int64)
            back[order] = at
            place[a], place[b] = back, back[::-1]
    return sums[root], where


def difference_items(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Differencing of single items into k parts: the sums, and the part of each item. While an item is alone its
    partition is (0, ..., 0, size), so only the non-zero tails of the sums are kept until they fill up."""
    n = len(sizes)
    tails: dict[int, list[int]] = {}
    heap = []
    for i, s in enumerate(sizes):
        tails[i] = [int(s)]
        heap.append((-int(s), i))
    if n == 0:
        return np.zeros(k, np.int64), np.zeros(0, np.int64)
    heapq.heapify(heap)
    tree, full, new = {}, {}, n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        # a, b: the k sums ascending, of which only the last ones are not 0
        x, y = full.pop(a, None), full.pop(b, None)
        if x is None:
            x = tails.pop(a)
        if y is None:
            y = tails.pop(b)
        if len(x) + len(y) <= k:
            # opposite order: y's large sums meet x's zeros, nothing is added up
            total = np.concatenate([np.asarray(y)[::-1], np.asarray(x)])
        else:
            p, q = np.zeros(k, np.int64), np.zeros(k, np.int64)
            p[k - len(x) :], q[: len(y)] = x, np.asarray(y)[::-1]
            total = p + q
        order = np.argsort(total, kind="stable")
        full[new], tree[new] = total[order], (a, b, order, len(x), len(y))
        low = 0 if len(total) < k else int(full[new][0])
        heapq.heappush(heap, (-int(full[new][-1] - low), new))
        new += 1
    root = heap[0][1]
    size_of = len(full[root]) if root in full else 1
    sums = np.zeros(k, np.int64)
    sums[k - size_of :] = full[root] if root in full else tails[root]
    part, place = np.zeros(n, np.int64), {root: np.arange(k - size_of, k)}
    for node in range(root, -1, -1):
        if node not in place:
            continue
        at = place.pop(node)
        if node < n:
            part[node] = at[0]
            continue
        a, b, order, lx, ly = tree[node]
        back = np.empty(len(at), np.int64)
        back[order] = at
        place[a], place[b] = back[len(back) - lx :], back[:ly][::-1]
    return sums, part


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``groups``: a written table of ``grp`` (binary) and ``bytes``. Gives ``grp, shard``."""
    spark = groups.sparkSession
    total, n = groups.agg(F.sum("bytes"), F.count("*")).first()
    if not n:
        return groups.select("grp", F.lit(0).alias("shard"))
    heavy_from = max(1, total // MICRO)
    heavy = sorted(groups.where(F.col("bytes") > heavy_from).collect(), key=lambda r: bytes(r.grp))  # fewer than MICRO rows
    cells = max(1, -(-n // CELL_GROUPS))
    light = groups.where(F.col("bytes") <= heavy_from).withColumn("cell", F.pmod(F.xxhash64("grp"), F.lit(cells)))

    def in_cell(key, frame):
        import pandas as pd

        frame = frame.sort_values("grp", key=lambda c: c.map(bytes.hex)).reset_index(drop=True)
        sums, part = difference_items(frame["bytes"].to_numpy(np.int64), MICRO)
        return pd.DataFrame({"cell": frame["cell"], "grp": frame["grp"], "bytes": frame["bytes"], "part": part})

    dealt = materialise(light.groupBy("cell").applyInPandas(in_cell, "cell long, grp binary, bytes long, part int"), "kk-cells")
    node = dealt.groupBy(F.col("cell").alias("node"), "part").agg(F.sum("bytes").alias("bytes"))
    route = None  # cell, part -> part of the current level's node
    while cells > 1:
        def merge(key, frame):
            import pandas as pd

            ids = np.sort(frame["node"].unique())
            at = np.searchsorted(ids, frame["node"].to_numpy())
            parts = np.zeros((len(ids), MICRO), np.int64)
            parts[at, frame["part"].to_numpy()] = frame["bytes"].to_numpy()
            _, where = difference(parts)
            return pd.DataFrame({"node": np.repeat(ids, MICRO), "part": np.tile(np.arange(MICRO), len(ids)), "up": key[0], "up_part": where.ravel(), "bytes": parts.ravel()})

        parent = node.withColumn("up", F.floor(F.col("node") / FAN_IN).cast("long"))
        merged = materialise(parent.groupBy("up").applyInPandas(merge, "node long, part int, up long, up_part int, bytes long"), "kk-merge")
        step = merged.select("node", "part", "up", "up_part")
        if route is None:
            route = step.select(F.col("node").alias("cell"), "part", F.col("up").alias("node"), F.col("up_part").alias("at"))
        else:
            route = route.join(step.select("node", F.col("part").alias("at"), "up", "up_part"), ["node", "at"]).select("cell", "part", F.col("up").alias("node"), F.col("up_part").alias("at"))
        node = merged.groupBy(F.col("up").alias("node"), F.col("up_part").alias("part")).agg(F.sum("bytes").alias("bytes"))
        cells = -(-cells // FAN_IN)
    top = {r.part: r.bytes for r in node.collect()}  # at most MICRO rows: one node is left
    sizes = [top.get(i, 0) for i in range(MICRO)] + [r.bytes for r in heavy]
    _, shard = difference_items(np.array(sizes, np.int64), shards)
    final = spark.createDataFrame([(i, int(shard[i])) for i in range(MICRO)], "at int, shard int")
    placed = dealt.select("grp", "cell", "part")
    if route is None:
        placed = placed.withColumn("at", F.col("part"))
    else:
        placed = placed.join(checked_broadcast(route.select("cell", "part", "at")), ["cell", "part"])
    placed = placed.join(F.broadcast(final), "at").select("grp", "shard")
    extra = spark.createDataFrame([(r.grp, int(s)) for r, s in zip(heavy, shard[MICRO:])], "grp binary, shard int")
    return placed.unionByName(extra)


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal whole groups of equal texts into ``shards`` shards of nearly equal bytes.

    Gives ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; only ids, sizes and 32-byte digests are shuffled.
    """
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("grp"),
    )
    rows = materialise(rows, "kk-rows")
    groups = materialise(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "kk-groups")
    most = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") > F.lit(max(1, int(most * HOT_SHARE)))).select("grp")  # fewer than 1 / HOT_SHARE rows
    placed = materialise(salted_left_join(rows, assign_groups(groups, shards), "grp", hot), "kk-placed")
    # slots: each shard is numbered in ranges of documents, so that no task orders a whole shard
    count = placed.count()
    ranges = max(1, -(-count // 50_000))
    lane = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(ranges))
    counts = placed.groupBy("shard", lane.alias("lane")).agg(F.count("*").alias("n"))
    before = counts.select("shard", "lane", (F.sum("n").over(Window.partitionBy("shard").orderBy("lane")) - F.col("n")).alias("base"))
    w = Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32")
    return (
        placed.withColumn("lane", lane)
        .withColumn("at", F.row_number().over(w) - 1)
        .join(checked_broadcast(before), ["shard", "lane"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("base") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
