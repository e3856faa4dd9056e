"""Resolution of logs, reads, the text index and maintenance."""
