"""DataFrame -> DataFrame operators over feedback tables."""
