"""Where triples, rules and results come from and go to."""
