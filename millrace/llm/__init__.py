"""Training-data operators: ten large-corpus steps and the queries that apply them.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
