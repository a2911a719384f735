"""Change feeds (an extension)."""
