"""Readers for record files, side files and the record view of an event table."""
