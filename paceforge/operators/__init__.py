"""Single operators over activities and samples."""
