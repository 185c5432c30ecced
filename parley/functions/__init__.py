"""Part of parley."""
