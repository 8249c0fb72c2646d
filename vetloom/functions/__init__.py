"""Part of vetloom."""
