"""Change feeds: snapshots, batches by gap, and refresh plans on Structured Streaming."""
