"""Operators for preparing text and set data at corpus scale. Nothing outside this package imports it."""
