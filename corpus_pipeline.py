"""Training-data pipeline over documents: toxicity, near-duplicates, benchmark decontamination, mixing, packed token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; what it returns is written as Parquet
in the shared folder and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, mixing, packing, simhash
from corvane.llm.common import materialize
from corvane.llm.tables import table
from corvane.llm.toxicity import toxic_rows


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models call toxic (score of 0.5 or more) go."""
    return toxic_rows(docs, table(spark, sf_dir, "labels"), toxic=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles of a similarity of 0.8 or more the one of the smallest id stays."""
    return simhash.one_of_each(docs, width=5, similarity=0.8, seed=42)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, exact or edited, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are drawn so that sources reach their temperature weights: scarce ones repeat, plentiful ones lose their surplus."""
    return mixing.mix(docs, seed=17, budget_share=1.0, entropy=0.95, repetition=4.0)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids."""
    return packing.pack(docs, length=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: The models and the tokenizer aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
