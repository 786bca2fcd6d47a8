"""Corpus pipeline: language ID, near-duplicates, repeated passages, benchmark contamination, tokens.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents. The last returns doc_id, n_tokens, ids_sha256, decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelace.llm import bpe, decontam, langid, simhash, suffix
from treelace.llm.common import crc_mod, free_name, materialize, only, table, without


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[df[c] for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language stay: `und`, and mixtures without a language of MIN_SHARE or more, go.

    The model learns from labelled rows outside the held-out fold.
    """
    model = langid.train(docs.where(crc_mod("doc_id", 4) != 2))
    return langid.filter_rows(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays: that with its smallest id, of several texts of that id the one with the smallest hash.

    A null id comes after all others, so a row with one stays only where its component has no other id.
    """
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", th.alias("th"))
    at = free_name("row", docs.columns)
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), th.cast("string"))
    found = simhash.near_duplicates(docs.select(row.alias("row"), "text"), "row")
    key = F.concat_ws(":", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.col("row.th").cast("string"))
    ids = materialize(found.groupBy(key.alias(at)).agg(F.count("*").alias("n"), F.count_if(F.col("row").eqNullSafe(F.col("component_id"))).alias("stays")), "pipeline-groups")
    tagged = docs.withColumn(at, name)
    once = without(tagged, ids.where("stays = 0 or n > 1").select(at), at)
    again = only(tagged, ids.where("stays > 0 and n > 1").select(at), at).dropDuplicates([at])
    return once.unionByName(again).select(*docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the bytes of repeated strings; a character cut in half goes as a whole. Every document stays."""
    into = tuple(free_name(x, docs.columns) for x in ("n_bytes", "spans", "kept"))
    out = suffix.remove_repeats(docs, whole_characters=True, into=into)
    changed = F.col(into[2]).isNotNull()
    text = F.when(changed, F.col(into[2]).cast("string")).otherwise(F.col("text"))
    out = out.withColumn("text", text).withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _columns(out, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which 1 word in 20 or more is in a benchmark passage go."""
    return decontam.filter_rows(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_digests(docs, bpe.default_vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode_tokens),
]

#: Only the third and fourth stage could be said in SQL; tests/llm/test_pipeline.py holds run() against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
