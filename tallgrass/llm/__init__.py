"""Training-data operators: ten self-contained dataflows over document tables."""
