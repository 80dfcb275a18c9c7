"""The same column functions over streams."""
