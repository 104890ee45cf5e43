"""Part of knotwork: functions."""
