"""Files, formats and models."""
