"""Scalar building blocks: message templates, log formats and path rules."""
