from wakeline.sources.events import positions_events
from wakeline.sources.files import (
    as_raw,
    columns_of,
    positions_csv,
    positions_lines,
    project_raw,
    read_raw_csv,
    write_positions_csv,
    write_raw_csv,
)
from wakeline.sources.shared import shared_folder, written

__all__ = [
    "as_raw",
    "columns_of",
    "positions_csv",
    "positions_events",
    "positions_lines",
    "project_raw",
    "read_raw_csv",
    "shared_folder",
    "write_positions_csv",
    "write_raw_csv",
    "written",
]
