"""The corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of `documents`. The last returns the
pieces of the packed sequences.
"""

from __future__ import annotations

from kinmatch.llm import decontamination, jaccard_join, packing, quality, secrets
from kinmatch.llm.common import staged, table


def quality_rules(spark, docs, sf_dir):
    """Rows that fail the rules or the classifier go; it is fitted on the labelled rows of `documents`."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_quality(docs, model)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a passage of `benchmark` go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark, docs, sf_dir):
    """Secrets in the texts are replaced by a mark."""
    return secrets.redact(docs)


def best_fit_packing(spark, docs, sf_dir):
    """The pieces of all documents, each with its sequence and offset."""
    return packing.pack_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]
#: A trained classifier decides in the first stage: SQL cannot express that.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs
