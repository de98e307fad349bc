"""Preparation of large text corpora: ten operators, each a Spark job over whole tables."""
