"""Part of gridstream: sources."""
