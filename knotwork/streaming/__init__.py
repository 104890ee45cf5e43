"""Part of knotwork: streaming."""
