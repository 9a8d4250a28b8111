"""Operators for training-data pipelines: ten of them, one module each, and their registered queries in ``queries``."""
