"""Readers and writers of text indexes, containers, logo models and raw frames."""
