"""Training-data operators: dedup, quality, mixing, PII, WARC, language ID, token stores, decontamination."""
