"""Operators for preparing training corpora (documents, pages, embeddings).

One module per operator, each a ``DataFrame -> DataFrame`` function that
keeps its own general interface; ``queries`` registers the thin ``opN_*``
queries over the driver tables. Nothing else in the library imports this
subpackage.
"""
