"""Scalar rules as pure ``Column -> Column`` functions."""
