"""streaming of diffloom."""
