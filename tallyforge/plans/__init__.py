"""Physical building blocks that several operators share."""
