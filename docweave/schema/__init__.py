"""Declarative document schemas: parsing, checking, and the types they give."""

from .mapping import content_hash, document_type, index_body
from .model import Field, Filter, Order, Schema, SchemaError, SoftDelete, Through
from .parse import dump_schema, load_schema, parse_schema

__all__ = ["Field", "Filter", "Order", "Schema", "SchemaError", "SoftDelete", "Through", "content_hash", "document_type", "dump_schema", "index_body", "load_schema", "parse_schema"]
