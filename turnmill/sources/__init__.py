"""Readers that turn raw files into message rows."""
