"""Reading and normalising amendment documents."""
