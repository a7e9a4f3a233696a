"""A corpus pipeline: documents to token shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``:

1. language: texts whose language cannot be told (null, no letters) go;
2. near_dedup: of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays;
3. decontaminate: documents that hold 0.8 of a benchmark item's five-word shingles go;
4. mix: sources are brought to their target weights; a row may come up to three times, or not at all;
5. tokens: texts become token ids in binary shards, from which each row's place and checksum are read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm.common import stash, table
from quillmere.llm.decontaminate import without_contaminated
from quillmere.llm.langid import with_language
from quillmere.llm.mixing import mixed
from quillmere.llm.near_dedup import one_of_each
from quillmere.llm.queries import tokenizer
from quillmere.llm.token_ids import read_shards, write_shards


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and letterless texts go, and all where no row is labelled; nulls elsewhere do not matter."""
    return with_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and wordless texts are copies of each other; a null doc_id is larger than all, ties go to the row stored first."""
    return one_of_each(docs, k=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts hold nothing and stay; null and empty items are in nothing."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"), similarity=0.8, k=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null source is a source, the last; a null text has no words and is taken by the same chances."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A null text has the end id alone; rows of a null doc_id come last, rows of one doc_id stay together."""
    # executors have done four stages by now: the encoder is to be small
    return read_shards(write_shards(docs, tokenizer("word_bpe_49k.json"), end_id=1, remembered=60_000, piece=1 << 20))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: The fingerprints, the classifiers and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
