"""rankloom sources."""
