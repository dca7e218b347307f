"""Stateful framed streams."""
