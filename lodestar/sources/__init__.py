"""Where collections come from and go to."""
