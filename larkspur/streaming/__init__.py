"""streaming of larkspur."""
