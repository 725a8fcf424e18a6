"""A corpus pipeline of five stages, each over all that its predecessor kept.

quality classifier, n-gram Jaccard join, benchmark decontamination, PII, best-fit packing. The first four return the
columns of documents: the first three drop rows, the fourth rewrites text (and n_chars); the last returns a row for
each packed piece. Between stages the table is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from gapwright.llm import decontamination, packing, pii, quality_model, similarity
from gapwright.llm.common import Scratch, table


def quality(spark, docs, sf_dir):
    """Documents that the rule ensemble scores at 0.3 or more."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), threshold=0.3)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group that links at a similarity of 0.75 or more."""
    return similarity.one_of_each(docs)


def decontaminated(spark, docs, sf_dir):
    """Documents without a copy of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def private(spark, docs, sf_dir):
    """Documents with personal data replaced by the kind's name."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def packed(spark, docs, sf_dir):
    """Pieces with their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0, capacity=2048)


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", private),
    ("packing", packed),
]
#: No stage but the last could be said in SQL; each is tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
