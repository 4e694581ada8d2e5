"""Readers, writers and bar views."""
