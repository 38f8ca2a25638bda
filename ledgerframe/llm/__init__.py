"""Training-data operators: dedup, tokens, packing, quality, safety and archive stages."""
