"""Training-data operators: one module for each, their queries in ``queries``.

Nothing else in the library imports this subpackage.
"""
