"""Writers of panels and results."""
