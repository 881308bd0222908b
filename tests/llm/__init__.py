"""Tests of the training-data operators (a package, so that its conftest keeps a name of its own)."""
