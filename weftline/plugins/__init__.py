"""Dispatch by condition, plugin loading, checked function signatures and attached methods."""
