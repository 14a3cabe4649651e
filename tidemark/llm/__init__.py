"""Training-data operators: near-duplicate joins, classifiers, packing, tokenising, search.

Nothing else in the library imports this subpackage.
"""
