"""A corpus from the documents table: the stages in order, each written as Parquet and read again before the next.

language_id drops documents without a known language or between two; exact_dedup keeps one of equal texts; near_dedup
keeps one document of each group linked by five-word shingles at a similarity of 0.8; mixing takes each source to its
target weight, full texts first, so a document may go or come twice; packing returns the pieces of token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugery.llm import exact_dedup, language_id, mixing, near_dedup, packing
from gaugery.llm.common import held_out, materialise, table


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs, learnable=~held_out())
    seen = language_id.predict(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns}), model, text_col="_text", keep_text=True)
    return seen.filter("lang_pred != 'und' and not ambiguous").select(*[seen[f"_{c}"].alias(c) for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, weight=mixing.full_texts)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", by_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Language identification and tokens have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
