"""Readers, writers, checkpoints and the views over the test tables."""
