"""Scratch tables of the operators in this subpackage: those of the engine."""

from ..scratch import Scratch, delete, shared_dir

__all__ = ["Scratch", "delete", "shared_dir"]
