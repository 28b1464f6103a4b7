"""Prompt-safety analytics as Spark DataFrame operators."""
