"""Whole computations: the batch over a panel, and the registered queries over the test tables."""
