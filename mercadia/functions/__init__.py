"""Column builders (scalar expressions) and the measure registry."""
