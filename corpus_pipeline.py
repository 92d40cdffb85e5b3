"""A corpus pipeline: quality rules, near-duplicates, secrets, the mix of sources, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last give the columns
of `documents`, and any further ones, whatever their names. An empty table gives
no rows in any stage. Texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import mixing, neardup, packing, quality, secretscan
from voxframe.llm.common import read_documents, stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted, without the lines above their source's limit that an earlier document which stays has; the others go.

    A null or empty text has no words and goes; a null source is a source of its
    own. Rows that share an id, or repeat each other, are documents of their own.
    """
    return quality.filter_documents(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by shingles of five words: the one with the smallest doc_id.

    A null id comes last; of rows that share the id, the first by text digest
    stays, once. Documents without words, null texts too, all stay.
    """
    return neardup.deduplicated(docs, size=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows too, secrets in them replaced by a mark; a null text stays null."""
    return secretscan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, repeated rows too, once at least; those of small sources up to twice, by weight. A null source is one of its own; a null text has no words."""
    return mixing.mixed_documents(docs, max_epochs=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences of 4096. A null text is the end id alone; each row is packed by itself."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The last stage's tokens can't be had in SQL; tests/llm holds each stage's and run()'s rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each staged in the shared folder."""
    docs = read_documents(spark, sf_dir)
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
