"""Operators of a training-data pipeline, each a plan over whole tables."""
