"""Column expressions shared by the table builders."""
