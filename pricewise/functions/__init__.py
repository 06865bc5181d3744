"""Column functions: scalar expressions and predicates (all JVM-side, no UDFs)."""
