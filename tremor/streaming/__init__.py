"""Streaming of the modal-analysis engine."""
