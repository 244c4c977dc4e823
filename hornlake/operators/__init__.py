"""Operators on triples, rules and draws."""
