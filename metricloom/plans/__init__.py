"""Dimension tables, derived inputs and the registered queries."""
