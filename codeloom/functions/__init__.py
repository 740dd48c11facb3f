"""Column-level functions and the small per-row Python helpers."""
