"""Readers from captured board payloads to the posting schema."""
