"""Column expressions: numbers, text, geometry, residues, chemistry."""
