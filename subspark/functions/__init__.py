"""Part of subspark."""
