"""Training-data operators: language id, deduplication, tokens, packing, media, scoring."""
