"""Part of skein; see README."""
