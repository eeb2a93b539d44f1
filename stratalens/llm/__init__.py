"""Training-data preparation operators; nothing else in the library imports this subpackage."""
