"""Operators for text that language models are trained on. Nothing else imports this package."""
