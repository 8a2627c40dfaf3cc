"""Preparing a text corpus for training: ten operators over ``documents``."""
