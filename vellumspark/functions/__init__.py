"""Part of the document-chunk engine."""
