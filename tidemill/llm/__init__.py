"""Training-data operators: filters, classifiers, de-duplication, search and mixing.

Nothing outside this subpackage imports it.
"""
