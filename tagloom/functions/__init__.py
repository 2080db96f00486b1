"""Part of tagloom."""
