"""Streams: first-wins selection over records that arrive in file order."""
