"""Reading and writing requests, the point table, JSON lines and query results."""
