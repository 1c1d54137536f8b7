"""Readers and writers: folders of photos, sidecars, presets, backups."""
