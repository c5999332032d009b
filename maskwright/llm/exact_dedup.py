"""Exact duplicates by deterministic block naming, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bytes in a block.
BLOCK = 2048
#: Groups of at least one in so many rows are joined by broadcast; there are no more than so many.
HOT = 1000


def _cut(text: Column, block: int) -> Column:
    """The text's UTF-8 bytes in blocks of ``block``; an empty text is one empty block.

    A slice of bytes costs its own length wherever it starts. The bytes are bound by a lambda, as they would
    be made anew for each block otherwise.
    """
    starts = lambda raw: F.sequence(F.lit(1), F.greatest(F.octet_length(raw), F.lit(1)), F.lit(block))
    return F.transform(F.array(text.cast("binary")), lambda raw: F.transform(starts(raw), lambda at: F.substring(raw, at, F.lit(block))))[0]


def _name_blocks(blocks: DataFrame) -> DataFrame:
    """Distinct blocks in sorted order as integers.

    Blocks meet under a 64-bit key, so that the text moves once. Distinct blocks that share a key are
    sorted and told apart by content; only these keep their text in the table of names.
    """
    distinct = blocks.groupBy("key").agg(F.sort_array(F.collect_set("block")).alias("same_key"))
    return stored(
        distinct.select("key", F.size("same_key").alias("n"), F.posexplode("same_key").alias("rank", "block"))
        .select("key", "rank", F.when(F.col("n") > 1, F.col("block")).alias("text"))
        .sortWithinPartitions("key", "rank")
        .select("key", "text", F.monotonically_increasing_id().alias("name")),
        "block-names",
    )


def block_identity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One collision-free identity (level, name) for each text.

    Level 0 names the fixed-size blocks of the bytes of all texts by their sorted content. Each further level names
    adjacent pairs of names, until a text has one name left. Two texts have equal (level, name) exactly
    if they are equal. Names are written before use, so that a lost executor can't change them.

    Returns ``id, print, level, name``, one row for each distinct (id, text); ``print`` is the text's
    xxhash64, which tells apart texts under one id. A null text counts as empty; a null id is an id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blocks = (
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("print"), _cut(text, block).alias("parts"))
        .select("id", "print", F.size("parts").cast("long").alias("nodes"), F.posexplode("parts").alias("pos", "block"))
        .withColumn("pos", F.col("pos").cast("long"))
        .withColumn("key", F.xxhash64("block"))
    )
    names = _name_blocks(blocks)
    clash = names.filter("text IS NOT NULL").limit(1).count() > 0
    if clash:
        named = blocks.alias("b").join(names.alias("n"), (F.col("b.key") == F.col("n.key")) & (F.col("n.text").isNull() | (F.col("n.text") == F.col("b.block"))))
    else:
        named = blocks.drop("block").join(names.drop("text"), "key")
    level, depth, done = stored(named.select("id", "print", "nodes", "pos", "name"), "named"), 0, []
    while True:
        done.append(level.filter("nodes = 1").select("id", "print", F.lit(depth).alias("level"), "name"))
        open_ = level.filter("nodes > 1")
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, done).distinct()
        pairs = stored(
            open_.groupBy("id", "print", F.ceil(F.col("nodes") / 2).alias("nodes"), F.expr("pos div 2").alias("pos")).agg(
                F.max(F.expr("IF(pos % 2 = 0, name, NULL)")).alias("left"),
                F.coalesce(F.max(F.expr("IF(pos % 2 = 1, name, NULL)")), F.lit(-1)).alias("right"),
            ),
            "pairs",
        )
        names = stored(
            pairs.select("left", "right").distinct().sortWithinPartitions("left", "right").withColumn("name", F.monotonically_increasing_id()),
            "pair-names",
        )
        level, depth = stored(pairs.join(names, ["left", "right"]).select("id", "print", "nodes", "pos", "name"), "named"), depth + 1


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Groups of equal texts; of each the row with the largest id stays.

    Returns for each row ``<id_col>, keep_id, group_size, kept, text_sha256, id_rows, key``. A null text counts as
    empty. Rows that repeat id and text are all returned and counted; ``id_rows`` says how many; ``key``
    is the text's xxhash64. A null id is the smallest; a group of null ids only has a null ``keep_id`` and
    keeps its rows. An empty table gives an empty result; other columns are not read. Rows of a group that
    holds one in ``HOT`` rows or more stay where they are, the group is sent to them; the others meet their
    groups by a shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    identity = block_identity(docs, id_col, text_col, block).withColumnsRenamed({"id": "i", "print": "p"})
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("print"), F.sha2(text, 256).alias("text_sha256"))
    rows = stored(rows.join(identity, F.col("id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("p"))).drop("i", "p"), "identities")
    groups = stored(rows.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    hot = stored(groups.filter(F.col("group_size") * HOT >= rows.count()), "hot-groups")
    names = ["level", "name"]
    grouped = rows.join(F.broadcast(hot), names).unionByName(rows.join(F.broadcast(hot), names, "left_anti").join(groups, names))
    repeats = rows.groupBy("id", "level", "name").count().filter("count > 1").select(F.col("id").alias("i"), F.col("level").alias("l"), F.col("name").alias("n"), F.col("count").alias("c"))
    return (
        grouped.join(repeats, F.col("id").eqNullSafe(F.col("i")) & (F.col("level") == F.col("l")) & (F.col("name") == F.col("n")), "left")
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
            F.coalesce("c", F.lit(1)).cast("long").alias("id_rows"),
            F.col("print").alias("key"),
        )
    )
