"""Column expressions: exact integer arithmetic, predicates, dictionary codes."""
