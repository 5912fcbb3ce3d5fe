"""Operators of a training-data pipeline over ``documents``, ``embeddings`` and ``pages``.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; ``registry`` derives the thin contract queries from them.
"""
