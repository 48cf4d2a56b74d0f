"""Operators for preparing training text at scale. Nothing else in loomseq imports this subpackage."""
