"""Operators for training data. Nothing else in chainloom imports this subpackage."""
