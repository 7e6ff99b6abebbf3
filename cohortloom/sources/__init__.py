from cohortloom.sources.files import (
    load_model,
    read_csv,
    read_keyed_folder,
    read_parquet,
    read_tsv,
    save_model,
    stack_by_name,
    write_csv,
    write_named_files,
    write_parquet,
)

__all__ = [
    "load_model",
    "read_csv",
    "read_keyed_folder",
    "read_parquet",
    "read_tsv",
    "save_model",
    "stack_by_name",
    "write_csv",
    "write_named_files",
    "write_parquet",
]
