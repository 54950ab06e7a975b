"""Readers, writers and fetch-side operators."""
