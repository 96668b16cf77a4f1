"""operators of diffloom."""
