"""Writers for results, traces and log tiers."""
