"""Intermediate tables in the folder that driver and executors share."""

from prosegrid.scratch import Scratch, shared_dir

__all__ = ["Scratch", "shared_dir"]
