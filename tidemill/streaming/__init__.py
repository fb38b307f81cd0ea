"""Fitted plans on streams."""
