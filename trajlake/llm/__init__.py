"""Operators for preparing training text: filters, scanners, deduplication, mixing and formatting."""
