"""Input tables: manifests and files, pages, recognition output, pricing, logs."""
