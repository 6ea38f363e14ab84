"""Batch and streaming jobs for large question banks and text corpora on Spark."""
