"""Training-data operators: dedup, language, toxicity, secrets, mixing, search."""
