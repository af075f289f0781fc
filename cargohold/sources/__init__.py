"""Sources: manifests, store listings, archives, image lists and remote assets."""
