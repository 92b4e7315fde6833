"""rankloom operators."""
