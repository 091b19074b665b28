"""Candles as a stream."""
