"""Operators for building training data from large text corpora.

Nothing outside this subpackage imports it; ``queries`` lists what it offers.
"""
