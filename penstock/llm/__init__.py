"""Operators for building training corpora. Nothing else in penstock imports this subpackage."""
