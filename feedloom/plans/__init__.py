"""Whole plans: extraction, discovery, synthesised pages."""
