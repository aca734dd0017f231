"""Part of gridstream: plans."""
