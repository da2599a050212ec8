"""Plans of the modal-analysis engine."""
