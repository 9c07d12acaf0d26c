"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  ``registry`` lists its
queries and SQL twins; each operator module keeps its own general interface.
"""
