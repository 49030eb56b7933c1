"""Training-data operators: deduplication, tokenising, scoring, extraction, decontamination."""
