"""Table schemas, loaders, the proxy over the driver star schema, and export."""

from ledgerlens.sources.tables import (  # noqa: F401
    COMMERCE_SCHEMAS, TABLE_NAMES, Tables, load_csv_tables, load_parquet_tables, row_count_manifest,
)
from ledgerlens.sources.proxy import proxy_tables  # noqa: F401
from ledgerlens.sources.export import export_table  # noqa: F401
