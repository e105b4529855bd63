"""Training-data operators: cleaning, matching, packing and archiving text corpora."""
