"""Part of tamis."""
