"""Training-data operators: cleaning, near-duplicates, search, mixing, tokens and scoring."""
