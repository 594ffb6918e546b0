"""Feature preparation and models on Spark MLlib."""
