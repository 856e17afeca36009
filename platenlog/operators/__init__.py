"""Batch operators over messages, requests, jobs, attributes, listings and announcements."""
