"""Quillstone: context-memory and corpus analytics expressed as Spark DataFrame plans."""
