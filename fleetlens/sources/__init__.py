"""Readers: driver tables, canonical fleet tables, whole text files."""

from fleetlens.sources.files import read_text_files, write_text_files
from fleetlens.sources.tables import DRIVER_TABLES, FLEET_SCHEMAS, Tables, fleet_table, table

__all__ = ["DRIVER_TABLES", "FLEET_SCHEMAS", "Tables", "fleet_table", "read_text_files",
           "table", "write_text_files"]
