"""Part of faultline."""
