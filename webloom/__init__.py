"""Web-archive and web-text analytics on Spark."""
