"""Session search and analytics as DataFrame operators."""
