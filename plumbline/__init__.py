"""plumbline: Spark jobs for private, trustworthy tables."""
