"""What is read and written: whole files, saved trees, sessions, scratch tables."""
