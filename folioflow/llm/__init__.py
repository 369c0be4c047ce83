"""Training-data operators: ten corpus-scale stages and the queries that apply them.

Nothing outside this subpackage imports it.
"""
