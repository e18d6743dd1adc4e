"""Physical-plan building blocks that keep hot keys from landing in one task."""
