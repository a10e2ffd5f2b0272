"""Matching, auditing and measuring text at scale, as PySpark table operators."""
