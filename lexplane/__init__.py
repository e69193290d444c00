"""Legal-knowledge analytics as DataFrame plans."""
