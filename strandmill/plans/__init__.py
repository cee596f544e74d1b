"""Workflows: stages with checkpoints, and the text and annotation pipelines."""
