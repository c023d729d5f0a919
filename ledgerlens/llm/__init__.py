"""Training-data operators: near-dedup, BPE, language ID, mixing, vector search, URL filters,
substring dedup, secret scans and LM scoring. Nothing else in the library imports this package."""
