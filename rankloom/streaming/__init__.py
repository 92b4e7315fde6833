"""rankloom streaming."""
