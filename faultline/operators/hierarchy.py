"""Parent-child links -> root, depth, path, descendants and loops of every node.

Weighted disjoint-set forests, merged in levels. Rows are ranged by their number, so most parents lie
in the same range; each range compresses its links to (local root, offset) on its own. Links that
leave a range are contracted to root-to-root links that carry the offset, a far smaller forest, which
is compressed the same way; offsets add up. Loops are recognised in the range or in the contracted
forest, their links are cut, and what leads into them is measured again.

Descendants are an interval: nodes are numbered in pre-order within their tree, and those below a node
have the numbers after its own, as many as it has descendants. The same forests give the numbers, with a
link weighing one more than the subtrees of the siblings before; subtree sizes come bottom-up over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.ordered import prefix_sums, row_numbers
from faultline.session import cut

RANGE_ROWS = 400_000  # nodes that one task compresses
ONE_TASK_LINKS = 2_000_000  # contracted links that one task may hold (48 MB); beyond, links are doubled over all tasks


def compress(ids: np.ndarray, parents: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root index, offset and loop number of each node of a forest with possible loops.

    ``parents`` are ids; -1 or an id not in ``ids`` makes the node a root. The loop number is the index
    of the loop's first node, -1 off loops; a loop's nodes are roots with offset 0.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    spot = np.searchsorted(ids, parents, sorter=order)
    spot[spot == n] = 0
    ptr = order[spot] if n else spot
    inside = (parents >= 0) & (ids[ptr] == parents) if n else np.zeros(0, bool)
    own = np.arange(n)
    ptr = np.where(inside, ptr, own)
    dist = np.where(inside, weights, 0)
    loop = np.full(n, -1, np.int64)
    step = ptr.copy()
    for _ in range(max(1, int(np.ceil(np.log2(max(n, 2)))) + 1)):
        nxt = step[step]
        if np.array_equal(nxt, step):
            break
        step = nxt
    ends = inside[step]  # after more steps than nodes only loops are still inside
    ends |= (ptr[step] != step)
    if ends.any():
        members = np.unique(step[ends])
        first = np.full(n, n, np.int64)
        first[members] = members
        hop = ptr.copy()
        for _ in range(int(np.ceil(np.log2(len(members) + 1))) + 1):  # least member by doubling around the loop
            first[members] = np.minimum(first[members], first[hop[members]])
            hop[members] = hop[hop[members]]
        loop[members] = first[members]
        ptr[members] = members
        dist[members] = 0
    selfs = (ptr == own) & inside & (loop < 0)  # a node that is its own parent
    loop[selfs] = own[selfs]
    dist[selfs] = 0
    for _ in range(int(np.ceil(np.log2(max(n, 2)))) + 1):
        nxt = ptr[ptr]
        if np.array_equal(nxt, ptr):
            break
        dist = dist + dist[ptr]
        ptr = nxt
    return ptr, dist, loop


_LOCAL = "id long, parent long, w long, cids array<string>, root long, off long, ext long, loop long"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if t is None or not t.num_rows:
        return
    ids, parents = t["id"].to_numpy(), t["parent"].fill_null(-1).to_numpy()
    root, off, loop = compress(ids, parents, t["w"].to_numpy())
    inside = np.isin(parents, ids)
    ext = np.where((loop[root] < 0) & ~inside[root] & (parents[root] >= 0), parents[root], -1)
    number = np.where(loop[root] >= 0, ids[loop[root]], -1)
    for name, x in (("root", ids[root]), ("off", off), ("ext", ext), ("loop", number)):
        t = t.append_column(name, pa.array(x, pa.int64()))
    yield from t.to_batches(max_chunksize=10_000)


def _local_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id`` and ``lpath``: the nodes above it in its range, nearest first. Written out in slices of nodes, so memory follows a slice and not the range."""
    batches = list(batches)
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    ids, parents = t["id"].to_numpy(), t["parent"].fill_null(-1).to_numpy()
    order = np.argsort(ids, kind="stable")
    spot = np.searchsorted(ids, parents, sorter=order)
    spot[spot == len(ids)] = 0
    up = np.where((parents >= 0) & (ids[order[spot]] == parents), order[spot], -1)
    for s in range(0, len(ids), 5_000):
        at = np.arange(s, min(s + 5_000, len(ids)))
        who, steps = [], []
        row, now = np.arange(len(at)), up[at]
        while len(now):  # one step up for all nodes of the slice at once
            live = now >= 0
            row, now = row[live], now[live]
            who.append(row)
            steps.append(ids[now])
            now = up[now]
        row, val = np.concatenate(who), np.concatenate(steps)
        by_row = np.argsort(row, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(at)))]).astype(np.int32)
        yield pa.record_batch([pa.array(ids[at]), pa.ListArray.from_arrays(pa.array(ends), pa.array(val[by_row]))], names=["id", "lpath"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = list(batches)
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    ids = t["id"].to_numpy()
    root, off, loop = compress(ids, t["parent"].to_numpy(), t["w"].to_numpy())
    parents = t["parent"].to_numpy()
    end = np.where(loop[root] >= 0, ids[root], np.where(np.isin(parents[root], ids), ids[root], parents[root]))
    off = off + np.where(loop[root] >= 0, 0, t["w"].to_numpy()[root])
    out = pa.table({"id": ids, "end": end, "off": off, "loop": np.where(loop[root] >= 0, ids[loop[root]], -1)})
    yield from out.to_batches(max_chunksize=50_000)


def _double(links: DataFrame, most: int) -> DataFrame:
    """``_contract`` over all tasks, by pointer doubling; for contracted forests too large for one task."""
    now = cut(links.select("id", F.col("parent").alias("end"), F.col("w").alias("off")))
    for _ in range(most.bit_length() + 1):
        far = now.select(F.col("id").alias("end"), F.col("end").alias("end2"), F.col("off").alias("off2"))
        nxt = cut(now.join(far, "end", "left").select("id", F.coalesce("end2", "end").alias("end"), (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"), F.col("end2").isNotNull().alias("moved")))
        now = nxt.select("id", "end", "off")
        if not nxt.where("moved").limit(1).count():
            return now.withColumn("loop", F.lit(-1).cast("bigint"))
    # whatever still moves after more steps than links runs around a loop; each loop is named by its least member
    inside = now.join(links.select(F.col("id").alias("end")), "end", "left_semi")
    on = inside.select(F.col("end").alias("id")).distinct()
    ring = cut(links.join(on, "id", "left_semi").select("id", F.col("parent").alias("hop"), F.col("id").alias("least")))
    for _ in range(most.bit_length() + 1):
        far = ring.select(F.col("id").alias("hop"), F.col("hop").alias("hop2"), F.col("least").alias("least2"))
        ring = cut(ring.join(far, "hop").select("id", F.col("hop2").alias("hop"), F.least("least", "least2").alias("least")))
    name = ring.select(F.col("id").alias("end"), F.col("least").alias("loop"))
    return now.join(name, "end", "left").select("id", "end", "off", F.coalesce("loop", F.lit(-1)).alias("loop"))


def _forest(nodes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(local, ends): every node (id, parent, w: weight of that link, cids) with its local root, and where each local root that leaves its range ends.

    ``local``: _LOCAL. ``ends``: (id, via, end, off, loop) for roots with an outside parent ``via``; loop
    is -1 or the number of the contracted loop the root leads into.
    """
    ranges = max(1, -(-n // RANGE_ROWS))
    placed = nodes.repartitionByRange(ranges, "id") if ranges > 1 else nodes.coalesce(1)
    local = cut(placed.mapInArrow(_local, _LOCAL))
    out = local.where("id = root AND ext >= 0").select("id", F.col("ext").alias("via"), F.col("w").alias("own"))
    if ranges == 1:
        return local, out.select("id", "via", F.col("id").alias("next"), F.col("id").alias("end"), F.lit(0).cast("bigint").alias("off"), F.lit(-1).cast("bigint").alias("loop")).limit(0)
    target = local.select(F.col("id").alias("via"), F.col("root").alias("parent"), F.col("off"))
    links = cut(out.join(target, "via").select("id", "via", "parent", (F.col("off") + F.col("own")).alias("w")))  # a parent number always exists: the caller drops the others
    many = links.count()
    if many <= ONE_TASK_LINKS:
        ends = links.select("id", "parent", "w").coalesce(1).mapInArrow(_contract, "id long, end long, off long, loop long")
    else:
        ends = _double(links.select("id", "parent", "w"), many)
    return local, cut(links.select("id", "via", F.col("parent").alias("next")).join(ends, "id"))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes on the way from a loop's entry (flag > -1 holds the loop's number) up to the local root."""
    batches = list(batches)
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    ids, parents, flag = t["id"].to_numpy(), t["parent"].fill_null(-1).to_numpy(), t["flag"].to_numpy()
    at = {int(i): k for k, i in enumerate(ids)}
    found: dict[int, int] = {}
    for k in np.flatnonzero(flag >= 0):
        number, k = int(flag[k]), int(k)
        while k is not None and k not in found:
            found[k] = number
            k = at.get(int(parents[k]))
    keys = np.fromiter(found, np.int64, len(found))
    yield from pa.table({"id": ids[keys] if len(keys) else ids[:0], "loop": pa.array(list(found.values()), pa.int64())}).to_batches()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id`` and ``size``: the sum of the weights ``v`` of a node and all below it in its range."""
    batches = list(batches)
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    ids, parents = t["id"].to_numpy(), t["parent"].fill_null(-1).to_numpy()
    order = np.argsort(ids, kind="stable")
    spot = np.searchsorted(ids, parents, sorter=order)
    spot[spot == len(ids)] = 0
    up = np.where((parents >= 0) & (ids[order[spot]] == parents), order[spot], -1)
    size = t["v"].to_numpy().astype(np.int64)
    while (up >= 0).any():  # what lies less than 2^k steps below moves up 2^k steps
        live = np.flatnonzero(up >= 0)
        more = np.zeros(len(ids), np.int64)
        np.add.at(more, up[live], size[live])
        size = size + more
        up = np.where(up >= 0, up[up], -1)
    yield from pa.table({"id": ids, "size": size}).to_batches(max_chunksize=50_000)


def _subtrees(ringed: DataFrame, n: int, local: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, n_descendants, pre): how many nodes are below each, and its number in pre-order within its tree, children by id."""
    ranges = max(1, -(-n // RANGE_ROWS))
    nodes = ringed.select("id", "parent")
    if ranges > 1:
        # contracted forest: the sum of what lies less than 2^k root-to-root links below moves up 2^k links
        total = cut(local.groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("s")).join(ends.select("id", F.col("next").alias("up")), "id", "left"))
        while total.where("up IS NOT NULL").limit(1).count():
            more = total.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("s").alias("more"))
            higher = total.select(F.col("id").alias("up"), F.col("up").alias("up2"))
            total = cut(total.join(more, "id", "left").join(higher, "up", "left").select("id", (F.col("s") + F.coalesce("more", F.lit(0))).alias("s"), F.col("up2").alias("up")))
        hung = ends.select("id", F.col("via")).join(total.select("id", "s"), "id").groupBy(F.col("via").alias("id")).agg(F.sum("s").alias("hung"))
        nodes = nodes.join(hung, "id", "left").select("id", "parent", (F.coalesce("hung", F.lit(0)) + 1).alias("v"))
        placed = nodes.repartitionByRange(ranges, "id")
    else:
        placed = nodes.withColumn("v", F.lit(1).cast("bigint")).coalesce(1)
    size = cut(placed.mapInArrow(_sizes, "id long, size long"))
    held = cut(ringed.select("id", "parent").join(size, "id"))
    before = prefix_sums(held.where("parent IS NOT NULL"), ["id"], {"before": "size"}, ["parent"]).select("id", (F.col("before") + 1).alias("w"))
    weighed = held.join(before, "id", "left").select("id", "parent", F.coalesce("w", F.lit(0)).cast("bigint").alias("w"), F.array().cast("array<string>").alias("cids"))
    inner, outer = _forest(cut(weighed), n)
    top = outer.select(F.col("id").alias("root"), F.col("off").alias("top"))
    pre = inner.select("id", "root", "off").join(top, "root", "left").select("id", (F.col("off") + F.coalesce("top", F.lit(0))).alias("pre"))
    return held.select("id", (F.col("size") - 1).alias("n_descendants")).join(pre, "id")


def _full_paths(open_nodes: DataFrame, n: int, local: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, path): all nodes above each node, nearest first; range by range, then segments of root-to-root links are doubled."""
    ranges = max(1, -(-n // RANGE_ROWS))
    placed = open_nodes.select("id", "parent").repartitionByRange(ranges, "id") if ranges > 1 else open_nodes.select("id", "parent").coalesce(1)
    own = cut(placed.mapInArrow(_local_paths, "id long, lpath array<long>"))
    if ranges == 1:
        return own.withColumnRenamed("lpath", "path")
    via = own.select(F.col("id").alias("via"), F.col("lpath").alias("vpath"))
    seg = cut(ends.join(via, "via").select("id", F.concat(F.array("via"), "vpath").alias("seg"), "next"))
    for _ in range(n.bit_length() + 1):
        far = seg.select(F.col("id").alias("next"), F.col("seg").alias("seg2"), F.col("next").alias("next2"))
        both = cut(seg.join(far, "next", "left").select("id", F.concat("seg", F.coalesce("seg2", F.array().cast("array<bigint>"))).alias("seg"), F.col("next2").alias("next")))
        seg = both
        if not both.where("next IS NOT NULL").limit(1).count():
            break
    tops = seg.select(F.col("id").alias("root"), "seg")
    joined = own.join(local.select("id", "root"), "id").join(tops, "root", "left")
    return joined.select("id", F.concat("lpath", F.coalesce("seg", F.array().cast("array<bigint>"))).alias("path"))


def resolve(links: DataFrame, with_paths: bool = False, with_descendants: bool = False) -> DataFrame:
    """(cid, kind, root_cid, depth), one row per distinct cid of ``links`` (cid, locid, parent).

    Both options add ``locid`` (the least of the cid; a rank where those don't tell nodes apart). ``with_paths`` adds ``path``
    (the numbers of all nodes above it, nearest first; up to the loop for a tail, empty on a loop), as long as the tree
    is deep. ``with_descendants`` adds ``root_id``, ``pre`` and ``n_descendants``: the nodes below it are those of the same root_id with
    the numbers pre + 1 to pre + n_descendants; see ``descendants``. Nodes of a loop are roots of what leads into them.

    ``parent`` is the lower-case 12-digit prefix of the parent's cid, or null. A parent that isn't a row
    counts as none. cids equal in their first 12 digits (any letter case) are one node; each keeps its
    row. If a cid's rows name different parents, that of the least locid holds. kind ``tree``: the root
    after ``depth`` steps; ``cycle``: on a loop, root_cid is its smallest cid; ``tail``: ``depth`` steps
    to the loop. Null cids give no row; an empty table gives none.
    """
    keyed = links.where("cid IS NOT NULL").select(F.lower(F.substring("cid", 1, 12)).alias("key"), "cid", "locid", "parent")
    rows = cut(keyed.groupBy("key").agg(F.collect_set("cid").alias("cids"), F.min("locid").alias("seq"), F.min_by("parent", F.struct("locid", "parent")).alias("parent")))
    # numbers follow the order of delivery, so that children and parents are near each other
    clash = rows.groupBy("seq").count().where("count > 1 OR seq IS NULL").limit(1).count()
    if clash:  # numbers that don't tell nodes apart are replaced by ranks in the same order
        rows = cut(row_numbers(rows.withColumn("seq", F.coalesce("seq", F.lit(0).cast("bigint"))), ["seq", "key"], "id").select("key", "cids", "id", "parent"))
    else:
        rows = rows.select("key", "cids", F.col("seq").alias("id"), "parent")
    parent = rows.select(F.col("key").alias("parent"), F.col("id").alias("parent_id"))
    nodes = cut(rows.join(parent, "parent", "left").select("id", F.col("parent_id").alias("parent"), F.lit(1).cast("bigint").alias("w"), F.array_sort("cids").alias("cids")))
    n = nodes.count()
    local, ends = _forest(nodes, n)

    cross = ends.where("loop >= 0")
    if cross.limit(1).count():  # loops over several ranges: find their nodes, cut them, measure again
        entries = cross.where("end = id").select(F.col("via").alias("id"), "loop")
        flags = entries.groupBy("id").agg(F.min("loop").alias("flag"))
        ranges = max(1, -(-n // RANGE_ROWS))
        flagged = nodes.select("id", "parent").join(flags, "id", "left").select("id", "parent", F.coalesce("flag", F.lit(-1)).alias("flag"))
        ring = cut(flagged.repartitionByRange(ranges, "id").mapInArrow(_mark, "id long, loop long"))
        ring = cut(ring.unionByName(local.where("id = root AND loop >= 0").select("id", "loop")).dropDuplicates(["id"]))
        open_nodes = nodes.join(ring, "id", "left").select("id", F.when(F.col("loop").isNull(), F.col("parent")).alias("parent"), "w", "cids")
        open_nodes = cut(open_nodes)
        local, ends = _forest(open_nodes, n)
    else:
        open_nodes = nodes
        ring = local.where("id = root AND loop >= 0").select("id", "loop")

    tops = local.where("id = root").select("id", "cids")
    final = tops.select("id").join(ends.select("id", "end", "off"), "id", "left").select("id", F.coalesce("end", "id").alias("end"), F.coalesce("off", F.lit(0)).alias("top_off"))
    names = tops.select(F.col("id").alias("end"), F.col("cids")[0].alias("end_cid"))
    loops = ring.join(nodes.select("id", F.col("cids")[0].alias("c")), "id")
    least = loops.groupBy("loop").agg(F.min("c").alias("loop_cid"))
    rings = ring.join(least, "loop").select(F.col("id").alias("end"), "loop_cid")
    roots = cut(final.join(names, "end", "left").join(rings, "end", "left").select(F.col("id").alias("root"), "end", "top_off", "end_cid", "loop_cid"))
    depth = F.col("off") + F.col("top_off")
    kind = F.when(F.col("loop_cid").isNull(), "tree").when((F.col("id") == F.col("end")), "cycle").otherwise("tail")
    found = local.select("id", "root", "off", "cids").join(roots, "root")
    shown = [F.explode("cids").alias("cid"), kind.alias("kind"), F.coalesce("loop_cid", "end_cid").alias("root_cid"), depth.cast("bigint").alias("depth")]
    if with_paths or with_descendants:
        shown.append(F.col("id").alias("locid"))
        ringed = cut(open_nodes.join(ring.select("id", F.lit(1).alias("on")), "id", "left").select("id", F.when(F.col("on").isNull(), F.col("parent")).alias("parent")))
    if with_paths:
        found = found.join(_full_paths(ringed, n, local, ends), "id")
        shown.append("path")
    if with_descendants:
        found = found.join(_subtrees(ringed, n, local, ends), "id")
        shown += [F.col("end").alias("root_id"), "pre", "n_descendants"]
    return found.select(*shown)


def descendants(resolved: DataFrame, of: DataFrame) -> DataFrame:
    """(locid, descendant): all nodes below those of ``of`` (locid), from a result ``with_descendants``; its size is the cost."""
    nodes = resolved.select("locid", "root_id", "pre", "n_descendants").distinct()
    below = nodes.join(of.select("locid").distinct(), "locid").where("n_descendants > 0").select("locid", "root_id", F.explode(F.sequence(F.col("pre") + 1, F.col("pre") + F.col("n_descendants"))).alias("pre"))
    return below.join(nodes.select("root_id", "pre", F.col("locid").alias("descendant")), ["root_id", "pre"]).select("locid", "descendant")
