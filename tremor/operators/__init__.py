"""Operators of the modal-analysis engine."""
