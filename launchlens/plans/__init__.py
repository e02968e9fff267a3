"""Whole workflows composed of the operators: two channels, and stores by district."""
