"""Finding and masking personal data and secrets in Spark tables."""
