"""Sources: source trees, symbols, hubs, vectors and change listings as DataFrames."""
