"""Training-data operators on documents and pages.

Ten operators, one module each, plus ``queries.py`` (the registered queries
and their SQL). Nothing else in the library imports this subpackage.
"""
