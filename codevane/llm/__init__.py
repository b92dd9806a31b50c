"""Operators that prepare large text corpora for training.

Nothing outside this subpackage imports it; ``registry`` lists its queries
and the SQL they are checked against.
"""
