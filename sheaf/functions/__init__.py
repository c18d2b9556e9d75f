"""functions of the page-stream engine."""
