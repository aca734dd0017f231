"""Part of gridstream: functions."""
