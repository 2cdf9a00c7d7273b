"""Multi-site solar production analytics on Spark."""
