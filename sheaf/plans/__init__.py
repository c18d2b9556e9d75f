"""plans of the page-stream engine."""
