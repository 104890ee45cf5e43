"""Part of knotwork: sources."""
