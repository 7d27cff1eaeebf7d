"""People-flow analytics over track tables and streams, as functions from DataFrame to DataFrame."""
