"""Package ``functions``."""
