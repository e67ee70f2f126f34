"""Document analytics and question answering on Spark."""
