"""Column functions: tokenizers, text helpers, vectors and scores."""
