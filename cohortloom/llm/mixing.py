"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's target over
its source's size, so the prefix sum of expected copies is the document's rank times that
number. Ranks run over documents in order of size, which makes the sample a stratified one: the
words taken miss the target by about one document. Documents of one size are in order of the MD5
of their id, so the order depends on the documents alone. Ranks come from counts: documents are
dealt to chunks of (source, size, first digits of the MD5), chunk counts give offsets, and only
within a chunk are rows put in order, so that no source and no size is ever in one task.

Sources are ranked by range partitions and the rows before each, and targets are reshared in
rounds of one aggregate each, so that neither many documents nor many sources meet in one task.
"""

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialise

DIGITS = 3  # of the MD5: 16**3 chunks for a source and size


def word_count(text):
    """Number of runs of bytes other than space and \\t to \\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Per source of (source, size): source_size and target.

    Sources take ``weights`` in turn, by code point, null last. Targets share ``share`` of all
    sizes by weight; none exceeds ``most`` times its source's size, the excess goes to the
    others by weight. Each round caps the sources that the level of the open ones would take
    above their cap, and what is left gives the next level, until no more are capped. Three sums
    a round reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # written once: the high bits of the place are the range partition, the low ones count in it
    placed = materialise(per.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("place", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each task
    offsets = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.col("place").bitwiseAND((1 << 33) - 1)
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    ranked = materialise(ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap")), "mix-weights")
    size, open_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    total = open_level = (size or 0) * share
    open_w, before = open_w or 0, 0
    while True:
        capped = F.col("cap") * F.lit(open_w) <= F.lit(float(open_level)) * F.col("w")
        n, caps, left = ranked.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w")))).first()
        if n == before or not left:
            break
        open_level, open_w, before = total - caps, left, n
    return ranked.select(
        "source",
        "source_size",
        F.when(capped, F.col("cap").cast("double")).otherwise(F.lit(float(open_level)) * F.col("w") / F.lit(open_w or 1)).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    seed: int = 7,
) -> DataFrame:
    """Per row: ``id_col``, size (words), source_size, target (its source's) and copies (how
    often the mix takes it, 0 to ``most``). Reruns agree: the one random offset comes from
    ``seed`` and the order within a source from size, MD5 of the id, id and text.

    Null text has size 0; a null source is a source of its own and comes last; null and
    repeated ids are rows like others. A source without words has target 0 and no copies. An
    empty table gives an empty result. Other columns are not looked at.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(text_col).alias("copy"),
        ),
        "mix-sizes",
    )
    chunk = ["source", "size", "part"]
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    rows = sized.withColumn("key", digest).withColumn("part", F.substring("key", 1, DIGITS))
    counts = rows.groupBy(*chunk).agg(F.count(F.lit(1)).alias("n"))
    up_to = (Window.unboundedPreceding, -1)
    alike = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    alike = alike.select("source", "size", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("size").rowsBetween(*up_to)), F.lit(0)).alias("earlier"))
    parts = counts.select(*chunk, F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(*up_to)), F.lit(0)).alias("inner"))
    a, b = parts.alias("a"), alike.alias("b")
    offsets = a.join(b, F.expr("a.source <=> b.source AND a.size = b.size")).select("a.*", (F.col("inner") + F.col("earlier")).alias("offset"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*chunk).orderBy("key", "id", "copy")) - 1)
    a, b, c = ranked.alias("a"), offsets.alias("b"), source_targets(sized, weights=weights, share=share, most=most).alias("c")
    u = random.Random(seed).random()
    rank = F.col("rank") + F.col("offset")
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor((rank + 1) * step + u) - F.floor(rank * step + u)
    return (
        a.join(b, F.expr("a.source <=> b.source AND a.size = b.size AND a.part = b.part"))
        .join(c, F.expr("a.source <=> c.source"))
        .select(
            F.col("a.id").alias(id_col),
            F.col("a.copy").alias("text_hash"),
            F.col("a.size").alias("size"),
            "source_size",
            "target",
            F.least(crossed, F.lit(most)).cast("int").alias("copies"),
        )
    )
