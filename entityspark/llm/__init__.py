"""Training-data operators: deduplication, language, packing, secrets, media, PII, scoring."""
