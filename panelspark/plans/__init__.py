"""Marts, model suites and registered queries composed from the operators."""
