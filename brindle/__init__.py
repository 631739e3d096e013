"""brindle: multi-source clustering and analytics on Spark."""
