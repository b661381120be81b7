"""Continuous answering of question streams."""
