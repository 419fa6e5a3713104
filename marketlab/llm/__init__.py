"""Training-data operators: quality, urls, extraction, deduplication, mixing, packing, scoring."""
