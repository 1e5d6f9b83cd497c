"""Readers, the project catalogue and the run log."""
