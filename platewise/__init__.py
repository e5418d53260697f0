"""Spark-first analytics for perturbation screens: sparse counts, matched log fold-changes, features, evaluation, and data preparation."""
