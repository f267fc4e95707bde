"""Operators for text corpora and set-valued records; nothing else in the library imports this subpackage."""
