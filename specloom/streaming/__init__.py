"""Spectra of arriving samples."""
