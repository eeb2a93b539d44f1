"""Plans: building, validating and publishing an index, and answering queries from it."""
