"""Spectral, structural and literature tables as Spark DataFrame operators."""
