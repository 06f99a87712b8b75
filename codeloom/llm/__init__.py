"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing else in the library imports this subpackage. Each operator is a function
from DataFrames to DataFrames; ``queries`` applies them to the provided tables.

Names: an operator that adds columns owns their names. An input column of the
same name (in any case) gives way to the operator's; columns an operator needs
only inside get names the input does not have.
"""
