"""Training-data operators: decontamination, dedup, mixing, extraction, scoring and token output."""
