"""Operators that prepare large text corpora for training; nothing else in plumbline imports this subpackage."""
