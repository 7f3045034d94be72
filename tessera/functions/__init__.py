"""Column functions: ontology lookups, text keys, sentiment, spans."""
