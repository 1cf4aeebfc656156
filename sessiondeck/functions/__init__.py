"""Scalar functions, as expressions over columns: all run in the JVM."""
