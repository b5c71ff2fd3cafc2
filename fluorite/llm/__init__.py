"""Training-data operators: ten operators over documents and embeddings, and their queries."""
