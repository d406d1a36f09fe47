"""Operators of a training-data pipeline over documents; nothing else imports this subpackage."""
