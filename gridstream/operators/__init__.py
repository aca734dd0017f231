"""Part of gridstream: operators."""
