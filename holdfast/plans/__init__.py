"""Pipelines, experiments and research runs on top of the operators."""
