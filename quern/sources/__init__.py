"""Readers, generators and constants."""
