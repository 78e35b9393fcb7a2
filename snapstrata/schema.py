"""Schemas of the persistent entities."""

from __future__ import annotations

BACKUPS = "hash string, message string, author string, timestamp bigint, chunk_size bigint, objects string, sealed boolean"  # objects: a folder
SCANNED = "path string, hash string, size bigint, content_type string, permissions int, chunks array<string>"
OBJECTS = f"backup_hash string, {SCANNED}"
CHUNK_INDEX = "chunk_hash string, refcount bigint, file string"
PAYLOADS = "chunk_hash string, payload binary"
CHUNKS = f"{PAYLOADS}, file string"
SUMMARIES = "ord bigint, hash string, message string, timestamp bigint, size bigint"
PENDING = "hash string, message string, compress int, chunk_size bigint, ignore_patterns array<string>, concurrency int, processed_chunks array<string>, uploaded bigint, packs array<string>"  # processed hashes lie in the packs
FILES = "path string, content binary, permissions int"

CONTENT_TYPE = "application/octet-stream"
