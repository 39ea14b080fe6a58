"""Corpus pipeline: documents in, deduplicated, decontaminated, mixed and sharded documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquery.llm import decontaminate, langid, mixing, sharding, simhash
from loomquery.llm._common import new_path, table

#: Outputs below this are no language's. With K languages an output is 1 / K at least, so up to five never fall below.
MIN_SCORE = 0.2
#: Texts whose n-grams are less usual than this in every language are far from all that was learned; 0 is chance, 1 the least usual learned texts.
MIN_NEAR = 0.5


def _packed(docs: DataFrame, *plain: str) -> DataFrame:
    """The columns that an operator reads, and all others in one, so that no name of theirs can clash."""
    return docs.select(*plain, F.struct(*(c for c in docs.columns if c not in plain)).alias("row"))


def _unpacked(docs: DataFrame, plain: tuple[str, ...]) -> list:
    """The columns of ``docs``, from a packed table."""
    return [F.col(c) if c in plain else F.col("row")[c].alias(c) for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null and empty texts and texts below MIN_SCORE or MIN_NEAR for every language.

    A row's fate depends on its text alone, so repeated rows share it; null ids and sources don't matter. An empty table,
    or one without labelled texts, gives no rows.
    """
    out = langid.predict(_packed(docs, "text"), langid.train(docs))
    fine = (F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__score") >= MIN_SCORE) & (F.col("__near") >= MIN_NEAR)
    return out.where(fine).select(*_unpacked(docs, ("text",)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of five-word similarity 0.8 or more, once.

    Rows with a null id stay, once for each text; a repeated row stays once; null, empty and wordless texts are one group.
    An empty table gives no rows.
    """
    groups = simhash.near_groups(docs)
    keep = groups.where("id is null or id = component").select(F.col("id").alias("near_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("text_hash"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(keep.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("near_id")), "left_semi")
    return rows.dropDuplicates(["id", "text_hash"]).select("row.*")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts hold none and stay; repeated rows share their text's fate; null items are no items. An empty table
    gives no rows.
    """
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: partitions are ranges of it, sorted, and so are the files written from it.

    Each source gets its target weight, a null source that of others; within a source, rows follow the hash of their id, null
    ids too, equal ids by their other columns. An empty table gives no rows.
    """
    out = mixing.pfair_mix(docs.select("doc_id", "source", F.struct(*docs.columns).alias("row")))
    return out.repartitionByRange("__mix_pos").sortWithinPartitions("__mix_pos").select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, and the place in the mixture that the files of the stage before hold them at.

    Rows ordered by (mix_file, mix_row) are the mixture; both are null where ``docs`` is not read from files. Null texts have
    0 bytes, null ids one hash. Columns named like a result are replaced. An empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("shard", "shard_depth", "shard_bytes", "mix_file", "mix_row")]
    if docs.inputFiles():
        at = F.struct(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("bigint").alias("file"), F.col("_metadata.row_index").alias("row"))
    else:
        at = F.lit(None).cast("struct<file: bigint, row: bigint>")
    plain = ("doc_id", "text")
    out = sharding.extendible_shards(docs.select(*plain, F.struct(*(c for c in kept if c not in plain)).alias("row"), at.alias("at")))
    columns = [F.col(c) if c in plain else F.col("row")[c].alias(c) for c in kept]
    return out.select(
        *columns, F.col("__shard").alias("shard"), F.col("__depth").alias("shard_depth"), F.col("__shard_bytes").alias("shard_bytes"), F.col("at.file").alias("mix_file"), F.col("at.row").alias("mix_row")
    )


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to the written table of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
