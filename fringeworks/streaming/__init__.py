"""Flagging of streams of visibilities."""
