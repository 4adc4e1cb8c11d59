"""Readers: tables, landed feeds and their writers."""
