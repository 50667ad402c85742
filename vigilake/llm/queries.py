"""The subpackage's registered queries and their SQL."""

import corpus_pipeline
from vigilake.llm import audit, collocations, exact_repeats, extraction, langid, mixing, passages, quality, simhash, templates, tokens, vectors, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_extraction": extraction.op4_extraction,
    "op5_simhash_dedup": simhash.op5_simhash_dedup,
    "op6_embedding_dedup": vectors.op6_embedding_dedup,
    "op7_repeated_passages": passages.op7_repeated_passages,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_decontamination": templates.op9_decontamination,
    "op10_language_id": langid.op10_language_id,
    "op11_exact_repeats": exact_repeats.op11_exact_repeats,
    "op12_collocations": collocations.op12_collocations,
    "op13_filter_audit": audit.op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

SQL = {"op2_mixing": mixing.op2_sql(), "op12_collocations": collocations.op12_sql(), "op13_filter_audit": audit.op13_sql()}
