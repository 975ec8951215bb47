"""Paths and files of any Hadoop file system."""
