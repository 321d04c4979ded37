"""Sessions over streams."""
