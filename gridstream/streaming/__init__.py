"""Part of gridstream: streaming."""
