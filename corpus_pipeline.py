"""From raw documents to packed training sequences, stage by stage.

Each stage is written as Parquet in the shared scratch folder and read again as the next one's documents.
Tokenisation is no SQL, so there is no ORACLE_SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evkit.llm.common import open_table
from evkit.llm.exact_dedup import drop_copies
from evkit.llm.mixing import mixed_rows
from evkit.llm.ngram_join import one_of_each
from evkit.llm.packing import pack
from evkit.llm.quality import fit, score
from evkit.session import write_once

ORACLE_SQL = None
# Five words and a similarity of 0.8, as near-duplicate stages take; scores below REJECT are junk.
WORDS, PERCENT = 5, 80
REJECT = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least REJECT, learnt from the labels outside the held-out fold.

    Null and empty texts are scored like others; an empty table stays empty.
    """
    voters = fit(docs, open_table(spark, sf_dir, "labels"))
    return score(docs, voters).filter(f"score >= {REJECT}").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case, null as empty) the row with the largest id. Rows without an id go if a copy has one."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, directly or not, the one of the smallest id.

    Texts without words and rows without an id stay.
    """
    return one_of_each(docs, words=WORDS, percent=PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, one or two times. Texts without words are not taken."""
    return mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids; repeated documents are packed each time."""
    return pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = open_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
