"""Sums over sites as a stream."""
