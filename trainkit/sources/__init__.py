"""Readers and writers of labelled files, run logs, predictions and codes."""
