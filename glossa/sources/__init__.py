"""Sources: parsers and readers that make the engine's tables."""
