"""logweave: maps log lines back to the source statements that wrote them, on Spark."""
