"""Vellum: a document-to-Markdown and corpus-processing engine written for Spark."""
