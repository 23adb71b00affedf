"""Operators that prepare text corpora for training language models; see the README of this folder."""
