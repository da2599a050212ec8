"""Functions of the modal-analysis engine."""
