"""Operators for training-data pipelines: packing, tokens, scans, de-duplication, scoring.

Nothing else in the library imports this subpackage; it may import the general
helpers of the library.
"""
