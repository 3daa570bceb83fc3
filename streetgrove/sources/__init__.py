"""Readers and decisions about incoming layers, sheets and drawings."""
