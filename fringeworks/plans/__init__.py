"""Reports, their text, and the fixed sequence of operations."""
