"""Scalar expressions, all inside the JVM."""
