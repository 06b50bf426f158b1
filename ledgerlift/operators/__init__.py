"""Measuring, judging, decoding and reshaping records."""
