"""Part of the dataset-curation engine."""
