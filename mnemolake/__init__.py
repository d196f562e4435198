"""A recall engine over text collections: search, fusion, re-scoring, summaries, assets and ingest as DataFrame plans."""
