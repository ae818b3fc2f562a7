"""Part of landloom."""
