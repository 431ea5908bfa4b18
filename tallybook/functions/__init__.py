"""Part of tallybook; see README.md."""
