"""Part of chainloom; see README.md."""
