"""Landing files to typed bronze tables, and tables to files."""
