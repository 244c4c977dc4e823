"""Rules and the join plans that they compile to."""
