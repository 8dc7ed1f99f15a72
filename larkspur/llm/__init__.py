"""Operators of a training-data pipeline: one module per operator, `queries` registers them.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
