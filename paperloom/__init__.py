"""Exam content and learning analytics as PySpark DataFrame operators."""
