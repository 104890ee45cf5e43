"""Part of knotwork: plans."""
