"""Writers: PNG, baseline JPEG."""
