"""A training corpus from raw documents: five stages, each on all that the one before kept."""

from vigilake.llm import langid, mixing, passages, simhash, templates
from vigilake.llm.common import staged, table

STAGES = [
    ("language ID", langid.stage),
    ("SimHash near-dedup", simhash.stage),
    ("substring dedup", passages.stage),
    ("benchmark decontamination", templates.stage),
    ("mixing", mixing.stage),
]

# Trained language ID, fingerprints and min-hash windows have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents; each one's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
