"""Whole pipelines: the posting view, a refresh run, a rescore."""
