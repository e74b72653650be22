"""Whole flows: from files to prepared examples, and from those to feature files."""
