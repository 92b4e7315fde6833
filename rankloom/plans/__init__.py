"""rankloom plans."""
