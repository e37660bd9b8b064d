"""Operators from visibility set to visibility set, and the counts that go with them."""
