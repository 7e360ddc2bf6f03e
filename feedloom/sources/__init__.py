"""Reading feedback files and tables, ingest bookkeeping, and writing results."""
