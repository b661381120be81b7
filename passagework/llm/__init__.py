"""Operators of a training-data pipeline over text corpora.

Nothing else in the library imports this subpackage; ``queries`` and ``oracles``
hold what ``__spark_entry__.py`` registers when the subpackage is present.
"""
