"""Whole-lot plans and the registered queries."""
