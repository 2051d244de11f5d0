"""Inventra: AI asset inventory analytics as Spark DataFrame operators."""
