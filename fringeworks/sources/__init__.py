"""Visibility sets: the model, tables on disk, and sets derived from other tables."""
