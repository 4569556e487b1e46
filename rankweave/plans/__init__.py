"""Composition: results, the search function and the registered queries."""
