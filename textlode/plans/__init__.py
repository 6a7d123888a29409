"""Session, sizing and storage helpers shared by the operators."""
