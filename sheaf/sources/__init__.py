"""sources of the page-stream engine."""
