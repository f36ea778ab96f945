"""Reading datasets and manifests, publishing results, auditing files."""
