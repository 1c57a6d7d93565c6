"""Training-data operators: fingerprints, scans, deduplication, mixing, tokenising, language ID."""
