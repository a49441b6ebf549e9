"""Report tables built from several operators."""
