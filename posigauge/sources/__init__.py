"""Readers and writers over landed files, literal dimensions and date spines."""
