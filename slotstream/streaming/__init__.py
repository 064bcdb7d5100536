"""Package ``streaming``."""
