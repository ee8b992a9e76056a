"""Readers, writers and derived demand tables."""
