"""Readers and writers."""
from quarry.sources.tables import (  # noqa: F401
    CLINICAL_SCHEMA,
    join_on_key,
    read_labels,
    read_table,
    schema_report,
    shape,
    with_roles,
    write_csv,
)
