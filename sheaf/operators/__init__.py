"""operators of the page-stream engine."""
