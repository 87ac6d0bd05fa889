"""A training corpus from the ``documents`` table: STAGES are applied one after
the other, each on all that its predecessor kept, with a parquet table on
shared storage between them (a lost executor costs part of one stage).

1. quality: documents that the classifier rejects go.
2. toxicity: documents that the lexicon rejects go.
3. near_duplicates: of each group of documents whose 5-word shingle sets
   overlap by 80 % or more, the one with the smallest id stays.
4. mixture: the rows are put in the order of the source mix. No row is dropped
   or repeated; the order is that of the written part files, by name, and of
   the rows in them.
5. tokens: ids of every document, with its position in the mix.

Edge cases: null and empty texts are scored, never linked with others, and
have no tokens; an empty table passes through all stages; columns beyond
those of ``documents`` are kept up to the mixture, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlens.llm import bpe, jaccard_join, mixing, quality, toxicity
from basketlens.llm.common import crc_remainder, drop_written, free_name, materialize, prepare, written
from basketlens.llm.queries import MIX_BLOCK, MIX_EXPONENT, vocabulary_path
from basketlens.session import ship_package
from basketlens.sources.tables import read_table

#: The tokens stage has no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least the threshold."""
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, quality.trusted_positives(read_table(spark, sf_dir, "labels"), held_out))
    score = free_name(docs, "score")
    return quality.score(docs, model, score_col=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold."""
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    lexicon = toxicity.learn(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    score = free_name(docs, "score")
    return toxicity.score(docs, lexicon, score_col=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix of their sources."""
    rows = mixing.scheduled(docs, mixing.temperature_weights(docs, MIX_EXPONENT), block_rows=MIX_BLOCK)
    return mixing.in_order(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; position is its place in the mix (from 0;
    null if ``docs`` isn't a scan of part files)."""
    rows = docs.select("doc_id", "lang", "source", "text")
    try:
        part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
        rows = docs.select("doc_id", "lang", "source", "text", part.alias("_part"), F.col("_metadata.row_index").alias("_row"))
        counts = docs.select(part.alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part file
        offsets = counts.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        rows = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_of")).withColumn("position", F.col("_before") + F.col("_row")).drop("_part", "_row", "_of", "_before")
    except AnalysisException:  # rows that are not read from files have no file position
        rows = rows.withColumn("position", F.lit(None).cast("long"))
    return bpe.digests(rows, vocabulary_path(), with_ids=True)


def _stage(fn):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        prepare(spark)
        return fn(spark, docs, sf_dir)
    run_stage.__name__, run_stage.__doc__ = fn.__name__, fn.__doc__
    return run_stage


STAGES = [(name, _stage(fn)) for name, fn in (
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixture", mix_sources),
    ("tokens", encode_tokens),
)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the corpus made from ``sf_dir``'s documents."""
    docs = read_table(spark, sf_dir, "documents")
    before = written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_written(spark, before, keep=1)  # later stages read only this one
    return STAGES[-1][1](spark, docs, sf_dir)
