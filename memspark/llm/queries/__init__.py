"""One module for each registered query."""
