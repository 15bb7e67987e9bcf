"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. ``run``
writes each stage as Parquet under spark.checkpoint.dir and reads it again as the next one's
documents. All stages but the last return the columns of ``docs``.

Decisions are tied to rows by two hashes, of the id and of the text, so that null ids, repeated
ids and repeated rows meet their own verdicts.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.decontaminate import contamination
from cohortloom.llm.line_dedup import line_dedup
from cohortloom.llm.mixing import mix_sources
from cohortloom.llm.ngram_join import ngram_components
from cohortloom.llm.toxicity import toxicity
from cohortloom.session import materialise

ID, TEXT = "doc_id", "text"
# the stages can't be said in SQL: two of them learn or search by iteration
ORACLE_SQL = None


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns in between that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
        taken.add(name)
    return out


def _keyed(docs: DataFrame, key: list[str]) -> DataFrame:
    return docs.withColumns({key[0]: F.xxhash64(F.col(ID)), key[1]: F.xxhash64(F.col(TEXT))})


def _verdicts(out: DataFrame, key: list[str], *columns) -> DataFrame:
    return out.select(F.xxhash64(F.col(ID)).alias(key[0]), F.col("text_hash").alias(key[1]), *columns)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go. Learns from the labels outside the held-out fifth."""
    labels = _table(spark, sf_dir, "labels").filter(F.crc32(F.col(ID).cast("string")) % 5 != 0)
    key = _free(docs, "id_hash", "text_hash")
    toxic = _verdicts(toxicity(docs, labels).filter("predicted = 1"), key).distinct()
    return _keyed(docs, key).join(toxic, key, "left_anti").select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that ten sources or more share, but for each line's first document;
    n_chars follows the text. Rows that lose all their lines go; rows without lines stay."""
    *key, kept, all_gone = _free(docs, "id_hash", "text_hash", "kept", "all_gone")
    out = line_dedup(docs).filter("n_removed > 0")
    emptied = F.col("n_removed") >= F.col("n_lines")
    changed = _verdicts(out, key, F.col("kept").alias(kept), emptied.alias(all_gone)).dropDuplicates(key)
    is_changed = F.col(all_gone).isNotNull()
    joined = _keyed(docs, key).join(changed, key, "left").filter(~F.coalesce(F.col(all_gone), F.lit(False)))
    text = F.when(is_changed, F.col(kept)).otherwise(F.col(TEXT))
    new = {TEXT: text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(is_changed, F.length(F.col(kept)).cast(kind)).otherwise(F.col("n_chars"))
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles of five words and a similarity of 0.8 the row with the
    smallest id stays, of several with that id the one with the smallest text hash."""
    out = ngram_components(docs, shingle=5, percent=80).filter("group_id IS NOT NULL")
    members = materialise(out.select("group_id", ID, "text_hash"), "pipeline-groups")
    first = members.groupBy("group_id").agg(F.min(F.struct(F.col(ID).isNull().alias("none"), ID, "text_hash")).alias("first"))
    gone = members.join(first, "group_id").filter(~(F.col(ID).eqNullSafe(F.col(f"first.{ID}")) & (F.col("text_hash") == F.col("first.text_hash"))))
    *key, repeated = _free(docs, "id_hash", "text_hash", "repeated")
    grouped = _verdicts(members.groupBy(ID, "text_hash").agg(F.count(F.lit(1)).alias("repeats")).filter("repeats > 1"), key, F.lit(True).alias(repeated))
    kept = _keyed(docs, key).join(_verdicts(gone, key).distinct(), key, "left_anti").join(grouped, key, "left")
    single = kept.filter(F.col(repeated).isNull()).select(*docs.columns)
    again = kept.filter(F.col(repeated)).dropDuplicates(key).select(*docs.columns)  # equal rows
    return single.unionAll(again)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain ten consecutive words of a benchmark item, or a whole shorter one, go."""
    out = contamination(docs, _table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    key = _free(docs, "id_hash", "text_hash")
    return _keyed(docs, key).join(_verdicts(out, key).distinct(), key, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes: the columns of ``docs`` and copy (from 1; copy_ where
    documents have a column of that name)."""
    *key, copy = _free(docs, "id_hash", "text_hash", "copy")
    taken = _verdicts(mix_sources(docs), key, "copies").groupBy(*key).agg(F.sum("copies").cast("int").alias(copy)).filter(F.col(copy) > 0)
    kept = _keyed(docs, key).dropDuplicates(key).join(taken, key)
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy)))).select(*docs.columns, copy)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
