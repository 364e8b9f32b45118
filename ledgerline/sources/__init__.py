"""Inputs and outputs: driver tables, account adapters, landed JSON, sinks."""
