"""Shared bases: the few passes over the data that all operators are derived from."""
