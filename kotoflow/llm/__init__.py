"""Operators for building language-model training data (one module per operator).

Nothing outside this subpackage imports it.  ``queries.py`` registers the
queries and their SQL; ``corpus_pipeline.py`` at the repository top chains five
of the operators.
"""
