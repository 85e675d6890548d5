"""Registered queries and their fixture views."""
