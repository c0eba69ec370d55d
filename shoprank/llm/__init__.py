"""Training-data operators (ten dealt operators and their queries); nothing else in the package imports this."""
