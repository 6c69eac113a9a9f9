"""The corpus pipeline: documents in, packed training sequences out.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
``run`` writes each stage's rows as Parquet in the shared folder and gives them, read again, to
the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from callsight.llm import decontaminate, exact, near, packing, quality
from callsight.llm.staging import stage, table


def quality_filter(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark, docs, sf_dir):
    """Of documents with equal texts the one with the largest doc_id stays."""
    return exact.deduplicate(docs)


def near_dedup(spark, docs, sf_dir):
    """Of each group of near duplicates the one with the smallest doc_id stays."""
    return near.deduplicate(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    """Every document's ids in sequences of at most 4,096."""
    return packing.pack(docs)


STAGES = [("quality", quality_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", packing_stage)]

#: trees, shingle similarity and tokenizing are not SQL; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
