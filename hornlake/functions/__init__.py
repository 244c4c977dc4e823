"""Statistics of triples and numeric functions."""
