"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Each operator module has a general interface;
``contracts.py`` holds the thin ``opN_<name>`` queries and their SQL.
"""
