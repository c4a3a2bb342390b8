"""Part of lacuna, see README."""
