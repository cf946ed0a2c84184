"""Part of wickerwork."""
