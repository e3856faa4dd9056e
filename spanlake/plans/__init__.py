"""Query specifications, predicates and file pruning."""
