"""A corpus from raw documents to token ids, as stages of corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder as
Parquet and reads them again as the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import byte_bpe, common, minhash, mixing, substring_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of toxicity.CUTOFF or more go."""
    return toxicity.accepted(docs, common.read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    return minhash.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; documents left without a word go."""
    return substring_dedup.deduplicated_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests."""
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Nearest examples, banding and BPE merging are beyond SQL. tests/llm holds substring_dedup against brute force, near-dedup
#: against an exact join, byte_bpe against the library, mixing against SQL, toxicity against brute-force neighbours and
#: held-out labels; test_pipeline holds run() against brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty and wordless texts stay until mixing, which takes none of them; with an empty table all stages are empty."""
    docs, follow = common.read(spark, sf_dir, "documents"), common.Stored()
    for name, stage in STAGES:
        docs = follow.next(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
