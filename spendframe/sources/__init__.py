"""Readers and the usage-line aggregate that feeds everything else."""
