"""Computations over ordered frames, packets, ranges and scores."""
