"""Training-data operators: cleaning, deduplication, mixing and encoding of text corpora at scale."""
