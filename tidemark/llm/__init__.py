"""Operators for preparing training data for language models.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.  Each operator has a module of its own, and
``queries`` holds the thin registered queries.
"""
