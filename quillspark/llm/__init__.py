"""Operators for large text collections used to train language models."""
