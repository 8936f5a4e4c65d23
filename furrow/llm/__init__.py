"""Operators for preparing training text; self-contained, nothing else imports this."""
