"""Package of streaming."""
