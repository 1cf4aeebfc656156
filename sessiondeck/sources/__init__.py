"""Where events come from: log formats, their discovery, and tables."""
