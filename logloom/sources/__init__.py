"""Where the engine's tables come from: logs, graphs, embeddings, manifests, reports, reviews and event streams."""
