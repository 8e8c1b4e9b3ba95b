"""Training-data operators: one module each, plus ``queries`` which applies them to the driver's tables.

Nothing else in the library imports this subpackage.
"""
