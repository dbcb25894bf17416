"""Exact dedup by content-defined chunk recipes, with DataFrame operations only.

A text is cut at places that its own characters decide (an ``e`` or a line end before a character of the set in
``CUT``, at least ``least`` and at most ``most`` characters after the last cut), so equal passages give equal
chunks.  Chunks are deduplicated by their content: each hash is checked to stand for one content, and a hash that
stands for several gets the content's digest as well.  A document then is the ordered list of its chunks'
identifiers, and equal lists are equal texts; no whole text is shuffled and each chunk at most once.

Skew: equal chunks and equal recipes are combined before the shuffle.  Groups with over a thousandth of all rows,
at most a thousand of them, are joined back by broadcast; the others by a shuffle join.

Defined cases: a null text is an empty text; of equal texts the row with the largest id stays, and rows that repeat
both id and text are all marked as staying; rows with null id form groups like others, and a group of such rows only
has a null keep_id and keeps none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cut may lie between one of the first and one of the second characters (about one place in a hundred of prose).
CUT = ("[e\\n.\\u0430\\u7684\\u0627]", "[ \\na-d,\\u0430-\\u0433]")
HOT_SHARE = 1000


def chunks(text: Column, least: int = 256, most: int = 2048) -> Column:
    """The chunks of a text, in order; they join up to the text."""
    pattern = f"(?s).{{{least},{most - 1}}}?{CUT[0]}(?={CUT[1]})|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exact_groups(docs: DataFrame, least: int = 256, most: int = 2048) -> DataFrame:
    """One row per document: the row of its group that stays, the size of the group, and the text's digest."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cut = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text"), least, most).alias("chunks"))

    # identifiers are verified: no hash stands for two contents
    content = cut.select(F.explode("chunks").alias("chunk")).distinct()
    doubtful = content.groupBy(F.xxhash64("chunk").alias("id")).count().where("count > 1").select("id")
    ids = F.transform("chunks", lambda c: F.xxhash64(c).cast("string"))
    if not doubtful.isEmpty():
        cut = _mark(cut, doubtful)
        ids = F.transform("chunks", lambda c: F.when(F.array_contains("doubtful", F.xxhash64(c)), F.sha2(c, 256)).otherwise(F.xxhash64(c).cast("string")))
    recipes = cut.select("doc_id", "text_sha256", ids.alias("recipe"))

    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    rows = F.broadcast(docs.agg(F.count("*").alias("rows")))
    groups = groups.where("group_size > 1").select(_key("recipe"), "keep_id", "group_size").join(rows)
    is_hot = F.col("group_size") * HOT_SHARE > F.col("rows")
    hot = groups.where(is_hot).select("key", F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"))
    rest = groups.where(~is_hot).select("key", "keep_id", "group_size")
    found = recipes.select("doc_id", "text_sha256", _key("recipe")).join(F.broadcast(hot), "key", "left")
    # rows of hot groups find no partner in the shuffle join, so they take a key of their own there
    found = found.withColumn("key", F.when(F.col("hot_size").isNull(), F.col("key")).otherwise(F.concat(F.lit("row "), F.col("doc_id").cast("string"))))
    found = found.join(rest, "key", "left")
    grouped = F.coalesce("hot_size", "group_size")
    keep_id = F.when(grouped.isNull(), F.col("doc_id")).otherwise(F.coalesce("hot_id", "keep_id"))
    return found.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce(grouped, F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(keep_id == F.col("doc_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def _key(recipe: str) -> Column:
    """The recipe in few bytes, for the joins; groups are made on the recipes themselves."""
    return F.sha2(F.array_join(recipe, " "), 256).alias("key")


def _mark(cut: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Give each document the list of its chunk hashes that stand for several contents."""
    own = cut.select("text_sha256", F.explode("chunks").alias("chunk")).select("text_sha256", F.xxhash64("chunk").alias("id"))
    own = own.join(doubtful, "id", "left_semi").groupBy("text_sha256").agg(F.collect_set("id").alias("doubtful"))
    return cut.join(own, "text_sha256", "left")
