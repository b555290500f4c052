"""Training-data operators: mixing, extraction, counting, scoring, deduplication and filtering of documents."""
