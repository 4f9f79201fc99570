"""Sources: source-file discovery and reading, workbook parsing, loaders, driver-table mapping."""
