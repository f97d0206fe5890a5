"""Batch operators over keyed, ordered sensor tables."""
