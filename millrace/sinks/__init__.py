"""Writers of the trusted and curated zones."""
