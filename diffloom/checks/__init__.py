"""Made-up hunks and file contents on which rules are checked that the delivered change sets hardly touch."""
