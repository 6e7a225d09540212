"""Training-data operators: language models, filters, deduplication and mixing over web-scale text tables.

Nothing else in the library imports this subpackage. Each operator lives in one module; :mod:`gazeframe.llm.queries`
registers one thin query for each of them.
"""
