"""Reading volumes, listings and manifests; writing reports, masks and journals."""
