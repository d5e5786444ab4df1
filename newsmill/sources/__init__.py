"""Readers and generators: events, raw objects, payloads, mail, page trees."""
