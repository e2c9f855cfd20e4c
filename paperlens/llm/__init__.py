"""Operators for preparing training data from documents and web pages."""
