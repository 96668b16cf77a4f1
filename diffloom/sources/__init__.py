"""sources of diffloom."""
