"""Curation of labelled records and evaluation of classifiers, as DataFrame functions."""
