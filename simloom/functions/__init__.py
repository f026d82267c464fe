"""Column expressions: headers, residues, positions, scores and selection predicates."""
