"""Part of proseloom."""
