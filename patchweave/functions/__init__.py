"""Part of patchweave."""
