"""Column helpers: labels, durations, formatting."""
