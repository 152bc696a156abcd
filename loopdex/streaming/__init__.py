"""Keystroke debounce, repeat suppression and resumable ingest."""
