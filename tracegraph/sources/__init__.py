"""Inputs and sinks: file inventory, gates, corpus rendering from tables."""
