"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm._util import Scratch, partitions

#: A dimension is compared on this many bits; ties are ordered by this many bits of the group's hash.
DIM_BITS, TIE_BITS = 20, 42
#: Bins of a histogram pass, and the share of a node's weight below which a bin is not refined further.
BINS, FINE = 2048, 1e-5


@dataclass
class Node:
    first: int
    shards: int
    dim: int = -1
    cut: int = 0
    low: Node | None = None
    high: Node | None = None


def _leaf(node: Node, shard: bool = False) -> Column:
    """The node (or shard) of a row as a CASE over the cuts so far."""
    if node.low is None:
        return F.lit(node.first)
    return F.when(F.col(f"k{node.dim}") < F.lit(node.cut), _leaf(node.low)).otherwise(_leaf(node.high))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.low is None else _leaves(node.low) + _leaves(node.high)


def _split_level(groups: DataFrame, root: Node, dims: int) -> bool:
    """Cut every leaf that still stands for more than one shard; all leaves share each pass."""
    open_nodes = {n.first: n for n in _leaves(root) if n.shards > 1}
    if not open_nodes:
        return False
    at = groups.withColumn("node", _leaf(root)).where(F.col("node").isin(list(open_nodes)))
    spans = [f(f"k{d}").alias(f"{s}{d}") for d in range(dims) for f, s in ((F.min, "lo"), (F.max, "hi"))]
    state = {}
    for r in at.groupBy("node").agg(F.sum("w").alias("w"), *spans).collect():
        width = [(r[f"hi{d}"] >> TIE_BITS) - (r[f"lo{d}"] >> TIE_BITS) for d in range(dims)]
        dim = width.index(max(width))
        shards = open_nodes[r["node"]].shards
        state[r["node"]] = {"dim": dim, "lo": r[f"lo{dim}"], "hi": r[f"hi{dim}"] + 1, "goal": r["w"] * (shards // 2) / shards, "w": r["w"], "below": 0}
    for first, node in open_nodes.items():
        if first not in state:  # no rows: everything goes to the first shard of the node
            state[first] = {"dim": 0, "lo": 0, "hi": 1, "goal": 0, "w": 0, "below": 0, "cut": 0}
    while todo := {k: s for k, s in state.items() if "cut" not in s}:
        binned = None
        for k, s in todo.items():
            s["step"] = max(1, -(-(s["hi"] - s["lo"]) // BINS))
            key = F.col(f"k{s['dim']}")
            here = (F.col("node") == k) & (key >= s["lo"]) & (key < s["hi"])
            value = F.expr(f"(k{s['dim']} - {s['lo']}L) div {s['step']}L")
            binned = F.when(here, value) if binned is None else binned.when(here, value)
        found = at.withColumn("bin", binned).where("bin is not null").groupBy("node", "bin").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect()
        for k, s in todo.items():
            below = s["below"]
            for r in sorted((r for r in found if r["node"] == k), key=lambda r: r["bin"]):
                if below + r["w"] >= s["goal"]:
                    start, end = s["lo"] + r["bin"] * s["step"], s["lo"] + (r["bin"] + 1) * s["step"]
                    if r["n"] == 1 or s["step"] == 1 or r["w"] <= FINE * s["w"]:
                        s["cut"] = start if s["goal"] - below <= below + r["w"] - s["goal"] else end
                    else:
                        s |= {"lo": start, "hi": end, "below": below}
                    break
                below += r["w"]
            else:
                s["cut"] = s["hi"]
    for first, node in open_nodes.items():
        half = node.shards // 2
        node.dim, node.cut = state[first]["dim"], state[first]["cut"]
        node.low, node.high = Node(node.first, half), Node(node.first + half, node.shards - half)
    return True


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Shards of nearly equal bytes: id, ``size``, ``text_crc32``, ``shard``, ``slot``.

    Rows with equal texts form one group that is never parted. A group has the size, the smallest id and
    the smallest value of each column in ``dims`` as coordinates, each scaled to 20 bits over the whole
    table. A node is cut at the weighted median (in bytes) of its widest coordinate; cuts inside a tie
    follow the group's hash. Medians come from histograms that all nodes of a level share, so the driver
    sees at most ``BINS`` rows per open node. Texts of any length are one row; rows that repeat are numbered one after
    the other; extra columns are ignored. With ``target_bytes`` the number of shards is the fewest whose
    mean is within the target. Null texts have no bytes, null coordinates sort first; an empty table
    gives no rows. ``slot`` numbers the rows of a shard from 0 without gaps.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = tuple(d for d in dims if d in docs.columns)
    named = [F.xxhash64(F.col(d).cast("string")).alias(f"m{i}") for i, d in enumerate(dims)]
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(text)).alias("h"), *named)
    rows = scratch.cut(rows, "rows")
    raw = [F.log2(F.max("size").cast("double")).alias("c0"), F.min(F.coalesce(F.col("id").cast("double"), F.lit(-1.0))).alias("c1")]
    raw += [F.min(F.shiftrightunsigned(f"m{i}", 11)).cast("double").alias(f"c{i + 2}") for i in range(len(dims))]
    groups = scratch.cut(rows.groupBy("h").agg(F.sum("size").alias("w"), *raw), "raw")
    n = len(raw)
    ends = groups.agg(*[f(f"c{i}").alias(f"{s}{i}") for i in range(n) for f, s in ((F.min, "lo"), (F.max, "hi"))], F.sum("w").alias("w")).first()
    if target_bytes is not None:
        shards = max(1, -(-(ends["w"] or 0) // target_bytes))
    tie = F.xxhash64("h").bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    keys = []
    for i in range(n):
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        scaled = F.floor((F.col(f"c{i}") - F.lit(lo)) * F.lit(((1 << DIM_BITS) - 1) / (hi - lo) if hi > lo else 0.0))
        keys.append((F.shiftleft(scaled.cast("long"), TIE_BITS) + tie).alias(f"k{i}"))
    keyed = scratch.cut(groups.select("h", "w", *keys), "keyed")
    root = Node(0, shards)
    while _split_level(keyed, root, n):
        pass
    scratch.drop("raw")
    placed = rows.join(keyed.select("h", _leaf(root).cast("int").alias("shard")), "h").select("id", "size", "text_crc32", "shard")
    deal = max(16, partitions(spark))
    placed = scratch.cut(placed.withColumn("deal", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(deal)).cast("int")), "placed")
    scratch.drop("rows", "keyed")
    before = Window.partitionBy("shard").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "deal").agg(F.count(F.lit(1)).alias("n")).select("shard", "deal", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "deal").orderBy("id", "text_crc32", "size")
    numbered = placed.withColumn("turn", F.row_number().over(order)).join(starts, ["shard", "deal"])
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + F.col("turn") - 1).cast("long").alias("slot"))
