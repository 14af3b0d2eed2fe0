"""Whole reports: named collections of lazily built result tables."""
