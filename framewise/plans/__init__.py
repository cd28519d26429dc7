"""Whole jobs: analysis, cutting, subtitles, logo learning, and their command line."""
