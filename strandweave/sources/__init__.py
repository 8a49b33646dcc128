"""Readers and adapters that give the frames the operators take."""
