"""Readers: fetch logs, page documents, declarations and attempt logs."""
