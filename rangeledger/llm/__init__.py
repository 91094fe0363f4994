"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` derives the registered digests from it.
"""
