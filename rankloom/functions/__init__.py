"""rankloom functions."""
