"""Training-data operators: mixing, URL lists, token counts, deduplication, rules, packing."""
