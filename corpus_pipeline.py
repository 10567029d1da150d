"""From raw documents to a training mix: five stages, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's documents. All but the last return the columns of ``documents``; the last one
repeats rows and adds ``epoch``.

1. toxicity: documents whose score reaches TOXIC_FROM go.
2. quality rules: documents that fail the base rules or break a rule go.
3. near duplicates: one document of each group at FIVE-word shingles and 0.8 stays.
4. decontamination: documents that hold COVERAGE of a benchmark item go.
5. mixing: sources are repeated and sampled to capped weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import minmax_dedup, mixing, quality_rules, string_tiling, toxicity
from loomframe.session import configure, new_path

TOXIC_FROM = 0.3  # as in op7_toxicity
SHINGLE, PERCENT = 5, 80
COVERAGE = 0.5
MIX_SHARE, MIX_EPOCHS, MIX_SEED, MIX_CYCLE = 1.5, 2, 17, (5.0, 2.0, 1.0)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, _read(configure(spark), sf_dir, "labels"))
    judged = toxicity.score(docs.withColumnsRenamed({"score": "_score", "predicted": "_predicted"}), model, TOXIC_FROM)
    kept = judged.filter("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({"_score": "score", "_predicted": "predicted"}).select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return quality_rules.keep(docs)


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return minmax_dedup.drop_near_duplicates(docs, SHINGLE, PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return string_tiling.drop_contaminated(docs, _read(configure(spark), sf_dir, "benchmark"), COVERAGE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    row = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    mixed = mixing.take(row, mixing.cycled_weights(docs, MIX_CYCLE), MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    repeated = mixed.filter("epochs > 0").select("row.*", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))).alias("epoch"))
    return repeated


STAGES = [
    ("toxicity", remove_toxic),
    ("quality rules", keep_quality),
    ("near duplicates", drop_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

# Trained scores, min-max bands and tiling have no SQL twin; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the shared folder and read again."""
    configure(spark)
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
