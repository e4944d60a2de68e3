"""Part of evigrain."""
