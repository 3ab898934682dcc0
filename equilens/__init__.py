"""Fairness audits, dataset profiles and data preparation as Spark DataFrame operators."""
