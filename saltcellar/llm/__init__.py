"""Operators of training-data pipelines: cleaning, de-duplication, scoring, formatting, mixing."""
