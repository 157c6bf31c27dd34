"""Ontologies: authoring, normal forms, and rules generated from axioms (driver-side)."""
