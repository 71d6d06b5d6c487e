"""Writers: design tables, molecule files, marked structures, reports."""
