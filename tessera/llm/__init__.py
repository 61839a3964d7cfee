"""Operations of a training-data pipeline: language ID, PII surrogates, deduplication, fingerprints, tokenisation,
packing, media columns and HTML extraction. Nothing outside this package imports it."""
