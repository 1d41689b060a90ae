"""Reading sources and writing results."""
