"""K-d tree sharding with DataFrame operations only.

The tree is grown level by level over a narrow table of the rows' metadata. A node that is to hold
k leaves is split along its widest dimension, relative to the whole table's range, at the weighted
quantile that leaves the share of its first floor(k / 2) leaves on the left; for two leaves this is
the weighted median. Quantiles of all nodes of a level are found together and exactly: a histogram
of BINS bins for each node picks the bin that holds the quantile, and that bin is divided again
until it is one value; groups of rows with that value are then told apart by a hash of their metadata.

Rows of equal metadata are a group and stay together. A group that is heavy beside a leaf would put
the cut that it straddles off, so such groups are dealt first, the heaviest first, to the leaf with
the most room, and the tree splits all else such that each leaf fills the room it has left. Only a
group that outweighs a whole leaf is divided, by a hash of its ids, where a cut goes through it.

All of it is DataFrame operations; what the driver knows (a row for each node, or each heavy group)
goes back into plans as local relations.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treelace.llm.common import free_name, local_rows, materialize, read_tables, release

BINS = 4096
#: Share of a node's bytes by which a cut may miss its target before groups of one value are told apart.
TOLERANCE = 0.001
#: A group is heavy from this share of a leaf's bytes, and from one part in MAX_HEAVY of all, so there are at most MAX_HEAVY.
HEAVY = 0.01
MAX_HEAVY = 100_000
#: Rows numbered by one task.
CHUNK_ROWS = 4096
_TIE = 1 << 40


def _cut(rows: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """(node, cut, below, at): the value that holds each node's target mass, the bytes below it and at it.

    rows(node, value, w); nodes(node, lo, hi, target) with 0 < target <= the node's bytes.
    """
    spark = rows.sparkSession
    span = nodes.agg(F.max(F.col("hi") - F.col("lo"))).first()[0]
    state = nodes.withColumn("below", F.lit(0).cast("long"))
    live = rows
    while True:
        width = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(BINS)).cast("long"))
        s = state.withColumn("width", width)
        bins = (
            live.join(F.broadcast(s), "node")  # a row for each node: at most the number of leaves
            .where((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
            .groupBy("node", ((F.col(value) - F.col("lo")) / F.col("width")).cast("long").alias("bin"))
            .agg(F.sum("w").alias("mass"))
        )
        upto = F.sum("mass").over(W.partitionBy("node").orderBy("bin"))
        hit = bins.withColumn("upto", upto).join(F.broadcast(s), "node").where(F.col("below") + F.col("upto") >= F.col("target"))
        first = hit.groupBy("node").agg(F.min_by(F.struct("bin", "upto", "mass", "lo", "hi", "width", "target", "below"), "bin").alias("h")).select("node", "h.*")
        state = first.select(
            "node",
            (F.col("lo") + F.col("bin") * F.col("width")).alias("lo"),
            F.least("hi", F.col("lo") + (F.col("bin") + 1) * F.col("width") - 1).alias("hi"),
            "target",
            (F.col("below") + F.col("upto") - F.col("mass")).alias("below"),
            F.col("mass").alias("at"),
        )
        got = state.collect()  # one row for each node
        state = local_rows(spark, got, state.schema)
        if span < BINS:
            return state.select("node", F.col("lo").alias("cut"), "below", "at")
        span = max(r["hi"] - r["lo"] for r in got)
        state = state.drop("at")


def _dealt(groups: list, leaves: int, total: int) -> tuple[list[tuple], list[float]]:
    """([(group, leaf)], room of each leaf): groups of at most a leaf's bytes, the heaviest first, to the leaf with the most room."""
    room = [total / leaves] * leaves
    heap = [(-x, leaf) for leaf, x in enumerate(room)]
    out = []
    for g in sorted(groups, key=lambda r: (-r[-1], tuple(r[:-1]))):
        if g[-1] > total / leaves:
            continue
        _, leaf = heap[0]
        room[leaf] -= g[-1]
        heapq.heapreplace(heap, (-room[leaf], leaf))
        out.append((*g[:-1], leaf))
    return out, [max(0.0, x) for x in room]


def kd_shards(points: DataFrame, dims: list[str], weight: str, id_col: str, leaves: int | None = None, target_bytes: int | None = None, into: str = "shard") -> DataFrame:
    """points with a column `into`: the leaf of a k-d tree, 0 to leaves - 1.

    dims are columns of whole numbers; null counts as 0. weight is a positive whole number, null
    counts as 1. leaves, or target_bytes of a leaf, from which leaves follow. Rows that are equal in
    dims have one leaf unless together they outweigh a leaf; then rows with equal ids do. An empty
    table gives an empty result. A column of points that is named like `into` is an error.
    """
    if into in points.columns:
        raise ValueError(f"column {into} is in points")
    spark = points.sparkSession
    taken = [*points.columns, into]
    names = [free_name(f"d{k}", taken) for k in range(len(dims))]
    w, tie, node, dealt = (free_name(x, taken) for x in ("w", "tie", "node", "dealt"))
    own = [F.col(f"`{c}`") for c in points.columns]
    cols = [F.coalesce(F.col(d).cast("long"), F.lit(0).cast("long")).alias(n) for d, n in zip(dims, names)]
    base = points.select(*own, *cols, F.coalesce(F.col(weight).cast("long"), F.lit(1).cast("long")).alias(w))
    root = base.agg(F.sum(w).alias("w"), *[F.min(c).alias(f"lo{c}") for c in names], *[F.max(c).alias(f"hi{c}") for c in names]).first()
    if root["w"] is None:
        return points.withColumn(into, F.lit(0))
    leaves = leaves or max(1, -(-root["w"] // target_bytes))
    range_of = [max(1, root[f"hi{c}"] - root[f"lo{c}"]) for c in names]
    least = max(HEAVY * root["w"] / leaves, root["w"] / MAX_HEAVY)
    groups = base.groupBy(*names).agg(F.sum(w).alias(w)).where(F.col(w) > least).collect()  # at most MAX_HEAVY rows
    given, room = _dealt(groups, leaves, root["w"])
    known = [*given, *((*g[:-1], -1) for g in groups if g[-1] > root["w"] / leaves)]  # -1: larger than a leaf
    heavy = local_rows(spark, known, ", ".join(f"`{c}` long" for c in names) + f", `{dealt}` int")
    tied = F.pmod(F.when(F.col(dealt) == -1, F.xxhash64(F.col(f"`{id_col}`"), *names)).otherwise(F.xxhash64(*names)), F.lit(_TIE))
    rows = materialize(base.join(F.broadcast(heavy), names, "left").select(*own, *names, w, dealt, tied.alias(tie), F.lit(0).cast("long").alias(node)), "kd-rows")
    ready = rows.where(F.col(dealt) >= 0).select(*own, F.col(dealt).alias(into))
    first_rows, rows = rows, rows.where(F.col(dealt).isNull() | (F.col(dealt) < 0))
    share = lambda first, k: sum(room[first : first + k]) or k
    nodes = {0: (0, leaves)}  # node -> its first leaf and how many
    level = None
    while any(k > 1 for _, k in nodes.values()):
        split = {n: x for n, x in nodes.items() if x[1] > 1}
        stats = rows.groupBy(node).agg(F.sum(w).alias("w"), *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in names]).collect()
        plan = []
        for r in stats:
            if r[node] in split:
                first, k = split[r[node]]
                wide = max(range(len(names)), key=lambda d: ((r[names[d]]["hi"] - r[names[d]]["lo"]) / range_of[d], -d))
                target = int(r["w"] * share(first, k // 2) / (share(first, k // 2) + share(first + k // 2, k - k // 2)))
                plan.append((r[node], wide, r[names[wide]]["lo"], r[names[wide]]["hi"], min(max(1, target), r["w"]), r["w"]))
        final = {}
        if plan:
            info = local_rows(spark, plan, "node long, dim int, lo long, hi long, target long, total long")
            value = F.element_at(F.array(*names), F.col("dim") + 1)
            narrow = rows.select(F.col(node).alias("node"), F.col(w).alias("w"), F.col(tie).alias("tie"), *names)
            valued = narrow.join(F.broadcast(info.select("node", "dim")), "node").select("node", "w", "tie", value.alias("v"))
            cuts = {r["node"]: r for r in _cut(valued, info.select("node", "lo", "hi", "target"), "v").collect()}
            ties = []
            for n, dim, _, _, target, total in plan:
                c = cuts[n]
                off_left, off_right = c["below"] + c["at"] - target, target - c["below"]
                if min(off_left, off_right) <= TOLERANCE * total:
                    final[n] = (n, dim, c["cut"], _TIE if off_left <= off_right else -1)
                else:
                    ties.append((n, 0, _TIE - 1, max(1, target - c["below"]), c["cut"], dim))
            if ties:
                at_cut = local_rows(spark, ties, "node long, lo long, hi long, target long, cut long, dim int")
                at = valued.join(F.broadcast(at_cut.select("node", "cut")), "node").where(F.col("v") == F.col("cut"))
                inner = {r["node"]: r for r in _cut(at.select("node", "w", F.col("tie").alias("v")), at_cut.select("node", "lo", "hi", "target"), "v").collect()}
                for n, _, _, target, cut, dim in ties:
                    c = inner[n]
                    up = c["below"] + c["at"] - target <= target - c["below"]
                    final[n] = (n, dim, cut, c["cut"] if up else c["cut"] - 1)
        key, dim, cut, upto = (free_name(x, [*taken, *names, w, tie, node, dealt]) for x in ("key", "dim", "cut", "upto"))
        where = local_rows(spark, list(final.values()), f"`{key}` long, `{dim}` int, `{cut}` long, `{upto}` long")
        value = F.element_at(F.array(*names), F.col(dim) + 1)
        left = (value < F.col(cut)) | ((value == F.col(cut)) & (F.col(tie) <= F.col(upto)))
        moved = rows.join(F.broadcast(where), rows[node] == where[key], "left")
        child = F.when(F.col(cut).isNull(), F.col(node) * 2).when(left, F.col(node) * 2).otherwise(F.col(node) * 2 + 1)
        grown = {}
        for n, (first, k) in nodes.items():
            if n in final:
                grown[2 * n], grown[2 * n + 1] = (first, k // 2), (first + k // 2, k - k // 2)
            else:  # a leaf, or a node without rows
                grown[2 * n] = (first, 1)
        nodes = grown
        rows = materialize(moved.select(*own, *names, w, tie, child.alias(node)), "kd-level")
        if level is not None:
            release(level)
        level = rows
    leaf_of = local_rows(spark, [(n, first) for n, (first, _) in nodes.items()], f"`{node}` long, `{into}` int")
    out = rows.join(F.broadcast(leaf_of), node).select(*own, into)
    if not given and level is not None:
        release(first_rows)
        return out
    return out.unionByName(ready)


def slots(rows: DataFrame, shard_col: str, order: list[str]) -> DataFrame:
    """rows with a column slot, 0 to n - 1 without gaps in each shard.

    A shard's rows are dealt into chunks of about CHUNK_ROWS by a hash, numbered in each, and moved
    up by what the chunks before hold, so that no task numbers a whole shard.
    """
    n = rows.count()
    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(max(1, n // CHUNK_ROWS))))
    sizes = dealt.groupBy(shard_col, "_chunk").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_base", F.sum("_n").over(W.partitionBy(shard_col).orderBy("_chunk")) - F.col("_n")).drop("_n")
    own = F.row_number().over(W.partitionBy(shard_col, "_chunk").orderBy(*order))
    return dealt.withColumn("_own", own).join(before, [shard_col, "_chunk"]).withColumn("slot", F.col("_base") + F.col("_own") - 1).drop("_chunk", "_own", "_base")


def shard_documents(docs: DataFrame, leaves: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) under the law `bytes`: shards hold near-equal bytes.

    The metadata are the text's bytes, its lines and its checksum, so equal texts are one group and
    share a shard, unless together they outweigh one. A null text has no bytes and size 1. Null ids
    are fine; repeated rows are kept; other columns are ignored; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    meta = docs.select(
        F.col(id_col),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)).cast("long").alias("lines"),
    )
    meta = materialize(meta, "kd-meta")
    sharded = kd_shards(meta, ["size", "lines", "text_crc32"], "size", id_col, leaves=leaves)
    return slots(sharded, "shard", [id_col, "text_crc32", "size"])


def op7_kd_shards(spark, sf_dir: str) -> DataFrame:
    (docs,) = read_tables(spark, sf_dir, "documents")
    out = shard_documents(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
