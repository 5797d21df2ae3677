"""Spark jobs that scan text for secrets, personal data and prompt injection, and audit agent runs."""
