"""Football match analytics on Spark."""
