"""Operators for preparing training data; nothing else in lumindex imports this subpackage."""
