"""The built-in log formats, in the order in which they are probed."""
