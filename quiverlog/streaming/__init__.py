"""Incremental maintenance: row normalizers and their change streams."""
