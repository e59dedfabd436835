"""Training-data operators: deduplication, quality, language, packing, search."""
