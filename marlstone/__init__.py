"""Spark-first engine for curating and analysing a multilingual article corpus."""
