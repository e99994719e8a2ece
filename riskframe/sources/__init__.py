"""Readers and writers: tables, uploads, metadata documents, models."""

from .documents import read_meta, write_meta
from .models import load_checked, load_model, save_model, save_preprocessing
from .tables import (
    first_existing,
    guarded_write,
    path_exists,
    read_split,
    read_table,
    require_absent,
    write_contributions,
    write_split,
    write_table,
)
from .uploads import read_upload

__all__ = [
    "first_existing", "guarded_write", "load_checked", "load_model", "path_exists", "read_meta", "read_split",
    "read_table", "read_upload", "require_absent", "save_model", "save_preprocessing", "write_contributions",
    "write_meta", "write_split", "write_table",
]
