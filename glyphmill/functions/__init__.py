"""Column functions over bytes, masks and packed tokens."""
