"""Source text to nodes and edges."""
