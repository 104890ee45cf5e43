"""Part of knotwork: operators."""
