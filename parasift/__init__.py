"""Bilingual document QA on Spark."""
