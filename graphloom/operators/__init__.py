"""Core data-processing operators."""
