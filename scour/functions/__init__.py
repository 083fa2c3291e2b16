"""Scalar building blocks.

Apart from conditions, they take and return SQL text: a nested expression then is one call to the
JVM, and the generated code stays small. Expressions that are used several times belong in their own
projection, see `scour.operators.changes`.
"""
