"""Interval analytics on single molecules as DataFrame operators."""
