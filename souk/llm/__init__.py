"""Training-data operators: one module per operator, ``queries.py`` registers them.

Nothing else in ``souk`` imports this package; it imports general helpers only.
"""
