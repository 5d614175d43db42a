"""Exact distinct counting with evidence, as Spark DataFrame operators."""
