"""Match, query, ranking and maintenance operators."""
