"""Package ``operators``."""
