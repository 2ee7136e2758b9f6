"""Tables as files for others."""
