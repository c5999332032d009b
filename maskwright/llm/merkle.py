"""Merkle manifest of a table: a tree of sha256 digests for each group, the groups' roots in one more tree, a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, stored

#: Children of a node.
FAN = 3
#: Levels that a block holds: FAN ** LEVELS rows, the most that meet in one row of a table.
LEVELS = 5
BLOCK = FAN**LEVELS

_GROUP = ["named", "name"]  # a null group sorts first
_STEP = "array<struct<before:string,after:string>>"


def leaf(*values: Column) -> Column:
    """Digest of a row: each value as ``byte count:value``, null as ``-``."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _over(n: Column | str, size: int) -> Column:
    """n / size, rounded up."""
    return F.expr(f"({n} + {size - 1}) div {size}")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, a row's rank in its group from 0, and ``n``, the group's rows.

    Rows are dealt in ranges of group and order and numbered where they are; the sizes of a group's
    parts give what stands before each. So no group has to meet in one task.
    """
    keys = [*_GROUP, *order]
    parts = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")), "ranked")
    sizes = parts.groupBy(*_GROUP, "part").agg(F.min("place").alias("first"), F.count("*").alias("size"))
    earlier = Window.partitionBy(*_GROUP).orderBy("part")
    sizes = stored(sizes.select(*_GROUP, "part", "first", F.sum("size").over(Window.partitionBy(*_GROUP)).alias("n"), (F.sum("size").over(earlier) - F.col("size")).alias("before")), "parts")
    joined = parts.join(hinted(sizes, sizes.count(), 160), [*_GROUP, "part"])
    return joined.select(*rows.columns, (F.col("before") + F.col("place") - F.col("first")).alias("at"), "n")


def _blocks(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Nodes of LEVELS levels over ranked rows with a ``node``; each block's rows nest in one struct.

    The digits of a rank in its block are grouped away one after the other, all in the one exchange that
    brings a block together. A level on which a group has a single node adds none.
    """
    digits = [f"d{k}" for k in range(LEVELS)]
    rank = lambda k: F.expr(f"cast((at div {FAN**k}) % {FAN} AS int)").alias(f"d{k}")
    keys = [*_GROUP, "block", "n"]
    df = rows.select(*_GROUP, F.expr(f"at div {BLOCK}").alias("block"), "n", *[rank(k) for k in range(LEVELS)], F.struct("node", *kept).alias("item"))
    df = df.repartition(*_GROUP, "block")
    for k, digit in enumerate(digits):
        df = df.groupBy(*keys, *digits[k + 1 :]).agg(F.sort_array(F.collect_list(F.struct(digit, "item"))).alias("kids"))
        below = F.transform("kids", lambda x: x["item"]["node"])
        node = F.when(_over("n", FAN**k) > 1, F.sha2(F.array_join(below, ""), 256)).otherwise(F.get(below, F.lit(0)))
        df = df.select(*keys, *digits[k + 1 :], F.struct(node.alias("node"), "kids").alias("item"))
    return df


def _proofs(blocks: DataFrame, kept: list[str]) -> DataFrame:
    """The rows of nested blocks with their proofs: what stands beside them, level by level, then their block's ``up``."""
    none = F.array().cast(_STEP)

    def beside(kids: Column, i: Column, level: int) -> Column:
        nodes = lambda some: F.array_join(F.transform(some, lambda x: x["item"]["node"]), "")
        step = F.struct(nodes(F.slice(kids, F.lit(1), i)).alias("before"), nodes(F.slice(kids, i + 2, F.lit(FAN))).alias("after"))
        return F.when(_over("n", FAN**level) > 1, F.array(step)).otherwise(none)

    def walk(item: Column, level: int, up: Column) -> Column:
        if level < 0:
            return F.array(F.struct(*[item[c].alias(c) for c in ("node", *kept)], up.alias("proof")))
        kids = item["kids"]
        return F.flatten(F.transform(kids, lambda x, i: walk(x["item"], level - 1, F.concat(beside(kids, i, level), up))))

    carried = [c for c in blocks.columns if c not in ("block", "n", "item", "up")]
    return blocks.select(*carried, F.inline(walk(F.col("item"), LEVELS - 1, F.col("up"))))


def _tree(rows: DataFrame, most: int, kept: list[str]) -> list[DataFrame]:
    """Tables of nested blocks, tier over tier, until each group has one node; ``most`` is the largest group's size."""
    tiers = [stored(_blocks(rows, kept), "tier")]
    while (most := -(-most // BLOCK)) > 1:
        nodes = tiers[-1].select(*_GROUP, F.col("block").alias("at"), _over("n", BLOCK).alias("n"), F.col("item.node").alias("node"))
        tiers.append(stored(_blocks(nodes, ["at"]), "tier"))
    return tiers


def _descend(tiers: list[DataFrame], kept: list[str], tops: DataFrame, carried: list[str]) -> DataFrame:
    """The lowest rows with their proofs. ``tops`` has, for each group, ``up`` (what its root's proof is) and columns to carry."""
    up = tops
    for tier in reversed(tiers[1:]):
        at = tier.join(up, [c for c in up.columns if c in (*_GROUP, "block")])
        up = _proofs(at, ["at"]).select(*_GROUP, F.col("at").alias("block"), F.col("proof").alias("up"), *carried)
        up = stored(up, "proofs")
    keys = [c for c in up.columns if c in (*_GROUP, "block")]
    side = hinted(up, up.count(), 4096) if tiers[1:] else up
    return _proofs(tiers[0].join(side, keys), kept)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, start, lambda done, step: F.sha2(F.concat(step["before"], done, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """One digest for all siblings of a proof, from the leaf to the root and from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(df: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", now: dict[str, Column] | None = None) -> DataFrame:
    """``<id>, leaf, subroot, root, proof, proof_sha256, folded_root, verified`` of each row.

    Rows of a group stand in ascending order of their ids, groups in that of their names' bytes, null
    first in both; rows that share an id in the order of their leaves, so that equal rows are
    interchangeable. Runs of three nodes make one until a group has one, the subroot, and the groups'
    subroots make the root in the same way; a lone leaf is its group's subroot. ``now`` has the columns
    whose present values may differ from those that the manifest was made of: ``folded_root`` is what
    they give with the manifest's siblings, ``verified`` if that is the root. Values are digested whole; null
    and empty differ. An empty table gives no rows. Other columns of ``df`` are not read.

    Digits of ranks are grouped away in blocks of 243 rows, blocks' nodes again in blocks, so that no row
    holds more than a block; transforms and one explode give a block's rows their proofs. Only whole blocks are joined with
    their own place in the tier above, one row with one row.
    """
    now = now or {}
    made = leaf(*[F.col(c) for c in fields])
    found = leaf(*[now.get(c, F.col(c)) for c in fields]) if now else made
    name = F.col(group_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), name.isNotNull().alias("named"), F.coalesce(name, F.lit("")).alias("name"), made.alias("node"), F.lit(None).cast("string").alias("found") if not now else found.alias("found"))
    # What did not change is not carried twice.
    rows = stored(rows.withColumn("found", F.nullif("found", "node")), "leaves")
    ids = ["id", "node", "found"]
    order = ranked(rows, ids)
    most = order.agg(F.max("n")).head()[0] or 0
    tiers = _tree(order, most, ["id", "found"])

    roots = tiers[-1].select("named", "name", F.col("item.node").alias("node"))
    groups = ranked(roots.select(F.lit(True).alias("named"), F.lit("").alias("name"), F.col("named").alias("of_named"), F.col("name").alias("of_name"), "node"), ["of_named", "of_name"])
    n_groups = groups.agg(F.max("n")).head()[0] or 0
    crown = _tree(groups, n_groups, ["of_named", "of_name"])
    top = crown[-1].select("item.node").head()
    root = F.lit(top[0] if top else None).cast("string")
    whole = crown[-1].select(*_GROUP).withColumn("up", F.array().cast(_STEP))
    named = _descend(crown, ["of_named", "of_name"], whole, [])
    tops = stored(named.select(F.col("of_named").alias("named"), F.col("of_name").alias("name"), F.col("node").alias("subroot"), F.col("proof").alias("up")), "tops")

    out = _descend(tiers, ["id", "found"], hinted(tops, n_groups, 4096), ["subroot"])
    out = out.select("id", F.col("node").alias("leaf"), "subroot", root.alias("root"), "proof", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.coalesce("found", "node"), F.col("proof")).alias("folded_root"))
    return out.withColumnRenamed("id", id_col).withColumn("verified", F.col("folded_root") == F.col("root"))
