"""Where nodes come from."""
