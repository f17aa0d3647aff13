"""Registered queries of the record engine."""
