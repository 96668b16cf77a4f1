"""functions of diffloom."""
