"""Training-data operators: deduplication, decontamination, tokenisation, filters and search."""
