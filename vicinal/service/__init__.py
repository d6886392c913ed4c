"""Thin adapters over collections: command line, JSON-RPC tools, REST."""
