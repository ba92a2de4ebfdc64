"""Reading and writing map data."""
