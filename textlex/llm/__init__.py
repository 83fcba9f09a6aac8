"""Operators for preparing large training corpora. Nothing else in textlex imports this subpackage."""
