"""Training-data operators: quality, near-duplicates, packing, tokens, archives, privacy, extraction, mixing, search."""
