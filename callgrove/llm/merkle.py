"""Operator 11: a Merkle manifest of a dataset, with a proof for each row, by butterfly exchange.

Each group of rows has a tree of fanout 8 over its leaves, and the roots of the groups have one more tree. Rows are placed in
their group by a range sort and counts of its partitions, so blocks of 8^4 consecutive leaves are aligned with the tree. A block hashes
its own part alone. Then blocks swap roots round by round: in round k those of one aligned run of 8^(k+1) blocks send the
ancestor that they hold to the blocks of the same place in the 7 other runs of 8^k, and everyone who receives a run hashes it.
So all blocks hash the same ancestors redundantly, and after the last round each has the siblings of its whole way up: nothing
goes downward, no task holds more than a block or a run, and rounds grow with the logarithm of the rows. A last, shorter run is sent
out by its blocks in turn.

Defined results: the hash H is the lowercase hex SHA-256 of its inputs, concatenated; null fields are `-`. Rows of a null group are a group
of their own, which comes first; in a group null keys come first; rows of equal key lie in the order of their leaves, and equal leaves are so
many leaves. A group of one row has that leaf as its root. An empty table gives no rows. Texts are hashed whole, in the scan. Other
columns, whatever their names, do not count.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.llm.common import sized, written
from callgrove.llm.native import ascii_lower

FANOUT, LOCAL_LEVELS = 8, 4
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    said = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def levels_of(n: int, fanout: int, most: int) -> int:
    """Levels above n nodes until one is left, at most so many."""
    k = 0
    while k < most and n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def climb(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level from the leaves up."""
    out = [nodes]
    for _ in range(levels):
        out.append([hashlib.sha256("".join(out[-1][i : i + fanout]).encode()).hexdigest() for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(tree: list[list[str]], at: int, fanout: int) -> list[dict[str, str]]:
    """For each level of the tree but the last, what stands left and right of the node above leaf `at` in its run."""
    path = []
    for nodes in tree[:-1]:
        start = at - at % fanout
        path.append({"left": "".join(nodes[start:at]), "right": "".join(nodes[at + 1 : start + fanout])})
        at //= fanout
    return path


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """rows (g, k, node and more) with pos, the place in group g by (k, node), and n, the rows of the group.

    One range sort over all rows; counts of (partition, group), as few as partitions and groups, give where each begins.
    """
    order = ["g", "k", "node", "place"]
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("place")
    numbered = written(dealt.withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))
    runs = numbered.groupBy("part", "g").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(runs.select(
        F.col("part").alias("p"), F.col("g").alias("h"), (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("base"), F.sum("c").over(Window.partitionBy("g")).alias("n"),
    ), f"{name}-bases")
    met = numbered.join(sized(bases), (F.col("part") == F.col("p")) & F.col("g").eqNullSafe(F.col("h")))
    return met.withColumn("pos", F.col("at") + F.col("base")).drop("at", "part", "p", "h", "base")


def block_roots(placed: DataFrame, fanout: int, local: int) -> DataFrame:
    """(g, b, nb, node, path): the root of each block, the number of the group's blocks, and a path without steps yet."""
    size = fanout**local

    def root(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n = block["n"][0].as_py()
        tree = climb(block["node"].to_pylist(), levels_of(n, fanout, local), fanout)
        return pa.table({"g": block["g"][:1], "b": [block["pos"][0].as_py() // size], "nb": [-(-n // size)], "node": tree[-1]})

    got = placed.select("g", "node", "pos", "n", F.floor(F.col("pos") / size).alias("b")).groupBy("g", "b").applyInArrow(root, "g string, b long, nb long, node string")
    return got.withColumn("path", F.array().cast(PATH))


def exchanged(state: DataFrame, step: int, fanout: int) -> DataFrame:
    """One round: blocks that hold ancestors over `step` blocks swap them within aligned runs of fanout * step blocks."""
    b, nb, ancestors = F.col("b"), F.col("nb"), F.ceil(F.col("nb") / step)
    own, place = F.floor(b / step), b % step
    first = own - own % fanout
    size = lambda t: F.least(F.lit(step).cast("long"), nb - t * step)

    def blocks_of(t: Column) -> Column:
        """Those of ancestor t's blocks that hear from this one: the same place, or in turn if this run is the shorter one."""
        return F.when(t == own, F.array(b)).when(place < size(t), F.transform(F.sequence(place, size(t) - 1, size(own)), lambda o: o + t * step)).otherwise(F.array().cast("array<bigint>"))

    to = F.when(ancestors > 1, F.flatten(F.transform(F.sequence(first, F.least(first + fanout - 1, ancestors - 1)), blocks_of))).otherwise(F.array(b))
    sent = state.select("g", "nb", F.struct(own.alias("a"), "node").alias("held"), F.explode(to).alias("to"), "b", "path").withColumn("path", F.when(F.col("to") == F.col("b"), F.col("path")))
    met = sent.groupBy("g", F.col("to").alias("b")).agg(F.max("nb").alias("nb"), F.sort_array(F.collect_list("held")).alias("run"), F.first("path", ignorenulls=True).alias("path"))
    joined = lambda keep: F.array_join(F.transform(F.filter("run", lambda x: keep(x["a"])), lambda x: x["node"]), "")
    step_up = F.struct(joined(lambda a: a < own).alias("left"), joined(lambda a: a > own).alias("right"))
    return met.select(
        "g", "b", "nb", F.when(ancestors > 1, F.sha2(joined(lambda a: a >= 0), 256)).otherwise(F.col("run")[0]["node"]).alias("node"),
        F.when(ancestors > 1, F.concat("path", F.array(step_up))).otherwise(F.col("path")).alias("path"),
    )


def acquired(placed: DataFrame, name: str, fanout: int, local: int) -> DataFrame:
    """(g, b, node, path): for each block the root of its group and its way there, after all rounds of the exchange."""
    state = written(block_roots(placed, fanout, local), f"{name}-blocks")
    most, step = state.agg(F.max("nb")).first()[0] or 0, 1
    while step < most:
        state, step = exchanged(state, step, fanout), step * fanout
    return written(state.drop("nb"), f"{name}-upper") if step > 1 else state.drop("nb")


def with_paths(placed: DataFrame, upper: DataFrame, fanout: int, local: int) -> DataFrame:
    """placed (without pos, n) with path, the siblings from the leaf to the root, left and right of each step; upper has (g, b, path)."""
    size, kept = fanout**local, [f for f in placed.schema.fields if f.name not in ("pos", "n")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    path_type = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def finish(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        tree = climb(block["node"].to_pylist(), levels_of(block["n"][0].as_py(), fanout, local) if len(block) else 0, fanout)
        rest = above["path"][0].as_py() if len(above) else []
        paths = [siblings(tree, at, fanout) + rest for at in range(len(block))]
        return block.select([f.name for f in kept]).append_column("path", pa.array(paths, path_type))

    blocks = placed.withColumn("b", F.floor(F.col("pos") / size)).groupBy("g", "b")
    return blocks.cogroup(upper.select("g", "b", "path").groupBy("g", "b")).applyInArrow(finish, f"{schema}, path {PATH}")


def proofs(rows: DataFrame, fanout: int = FANOUT, local: int = LOCAL_LEVELS) -> DataFrame:
    """rows (g: group, k: key, node: leaf, and more) with subroot, root and path: the siblings from the leaf to the root of all."""
    placed = ranked(rows, "merkle-leaves")
    upper = acquired(placed, "merkle", fanout, local)
    groups = ranked(upper.where("b = 0").select(F.lit("").alias("g"), F.col("g").alias("k"), "node"), "merkle-groups")
    top = acquired(groups, "merkle-top", fanout, local)
    roots = top.where("b = 0").select(F.col("node").alias("root"))
    # one row: the root of all groups
    ways = with_paths(groups, top, fanout, local).select(F.col("k").alias("h"), F.col("node").alias("subroot"), F.col("path").alias("rest")).crossJoin(F.broadcast(roots))
    ways = written(ways, "merkle-ways")
    whole = upper.join(sized(ways), F.col("g").eqNullSafe(F.col("h"))).select("g", "b", F.concat("path", "rest").alias("path"))
    return with_paths(placed, whole, fanout, local).join(sized(ways.drop("rest")), F.col("g").eqNullSafe(F.col("h"))).drop("h")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its way up give."""
    return F.aggregate(path, leaf, lambda node, step: hashed(step["left"], node, step["right"]))


def path_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, and whether each row still proves itself after a third of the texts was lowered."""
    leaf = lambda text: hashed(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 3 == 0) & F.col("text").isNotNull()
    own = leaf(F.col("text"))
    rows = docs.select(F.col("lang").alias("g"), F.col("doc_id").cast("long").alias("k"), own.alias("node"), F.when(tampered, leaf(ascii_lower(F.col("text")))).alias("now"))
    got = proofs(written(rows, "merkle-hashes"))
    return got.select(
        F.col("k").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("now", "node"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
