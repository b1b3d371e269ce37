"""Operators for building training corpora, as Spark jobs.

Each module holds one operator with its own general interface; ``catalog``
derives the registered queries from them.  Nothing outside this package
imports it.
"""
