"""Package ``sources``."""
