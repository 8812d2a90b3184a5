"""Mapping logs as they grow."""
