"""Part of mixloom."""
