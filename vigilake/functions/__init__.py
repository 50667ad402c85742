"""Column-level building blocks: text spans, canonical JSON, variants."""
