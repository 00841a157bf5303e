"""Training-data operators: filters, classifiers, deduplication, search, mixing, sharding.

Nothing else in the library imports this subpackage.  ``queries`` applies each operator to
the given tables; the operators take any DataFrame and column names.
"""
