"""Readers for events, requests, query logs, rules and stored tables."""
