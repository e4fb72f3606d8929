"""Training-data operators: search, de-duplication, filtering, packing.

One module per operator; ``queries.py`` registers one thin query for each.
Nothing else in the library imports this subpackage.
"""
