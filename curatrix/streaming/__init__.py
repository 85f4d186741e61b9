"""Streaming forms of the batch operators; an extension, held to their batch results."""
