"""streaming of the page-stream engine."""
