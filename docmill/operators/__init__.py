"""Set-oriented operators over manifests, pages, attempts, usage, results and logs."""
