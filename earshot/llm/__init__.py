"""Operators for preparing training text, over tables with ``doc_id`` and ``text``."""
