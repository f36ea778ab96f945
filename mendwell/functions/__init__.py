"""Column expressions: canonical text, fault transforms, checks and fixes."""
