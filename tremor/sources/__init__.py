"""Sources of the modal-analysis engine."""
