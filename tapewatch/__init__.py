"""Tapewatch: market surveillance and corpus preparation as Spark DataFrame transforms."""
