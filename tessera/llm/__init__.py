"""Operators of a training-data pipeline. Nothing else in the library imports this
subpackage; the registered queries are in :mod:`tessera.llm.queries`."""
