"""plans of diffloom."""
