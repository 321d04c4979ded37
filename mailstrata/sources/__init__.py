"""Capture files as tables: formats, packets, sessions."""
