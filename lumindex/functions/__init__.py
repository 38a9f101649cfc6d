"""Part of lumindex."""
