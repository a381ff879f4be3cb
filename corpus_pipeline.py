"""Corpus pipeline: documents to packed sequences, stage by stage.

Each stage works on all that its predecessor kept. Language ID keeps the documents it accepts,
exact dedup and SimHash keep one document of each group, mixing repeats and trims documents to the
target weights of their sources, and packing lays the tokens of what is left into sequences.
"""

from __future__ import annotations

from haulframe.llm.common import documents, prepare_python
from haulframe.llm.exact_dedup import drop_exact_copies
from haulframe.llm.language_id import drop_rejected
from haulframe.llm.mixing import mixed_documents
from haulframe.llm.packing import pack
from haulframe.llm.simhash import drop_near_copies
from haulframe.sources.storage import scratch_path


def language_id(spark, docs, sf_dir):
    """Documents whose text is like one of the learned languages."""
    return drop_rejected(docs)


def exact_dedup(spark, docs, sf_dir):
    """One of the documents that are equal but for white space."""
    return drop_exact_copies(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each component of near copies."""
    return drop_near_copies(docs)


def mixing(spark, docs, sf_dir):
    """Documents repeated and trimmed to the target weights of their sources."""
    return mixed_documents(docs)


def best_fit_packing(spark, docs, sf_dir):
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return pack(docs, capacity=2048, kept=KEPT_CHUNKS)


# Executors serve all stages in turn, so each is given less memory than alone: bytes of text handed
# to Python at once, and chunks whose ids a worker remembers.
ARROW_BYTES = 1024**2
KEPT_CHUNKS = 150_000

STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mixing),
    ("best_fit_packing", best_fit_packing),
]

# Language models, multinomial draws and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``, each written as Parquet and read again."""
    prepare_python(spark, ARROW_BYTES)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
