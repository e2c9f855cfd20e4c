"""Multi-step builds that read and write catalog datasets."""
