"""Requests and how they become plans."""
