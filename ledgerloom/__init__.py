"""Reconciliation of financial feeds as Spark DataFrame operators."""
